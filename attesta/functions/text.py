"""Text algebra as column expressions: folding, normalisation, tokens, quoted spans, bracketed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARKER = r"\[[a-z0-9-]+#[^\]]*\]"
MIN_SPAN = 20
EDGES = " .,;:"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_punct(c: Column | str) -> Column:
    """Curly quotes, dashes and the ellipsis in their ASCII forms."""
    return F.replace(F.translate(col(c), "‘’“”—–", "''\"\"--"), F.lit("…"), F.lit("..."))


@F.arrow_udf(StringType())
def _nfkc(texts):
    import unicodedata

    import pyarrow as pa

    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(c: Column | str) -> Column:
    """NFKC, which Spark lacks; ASCII text doesn't leave the JVM."""
    c = col(c)
    odd = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfkc(odd), c)


def trim_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def one_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalize(c: Column | str, compose: bool = True) -> Column:
    """Folded, NFKC, bracketed ids taken out, white space collapsed, trimmed, lower case."""
    c = fold_punct(c)
    c = nfkc(c) if compose else c
    return F.lower(one_space(F.regexp_replace(c, MARKER, " ")))


def needle(c: Column | str, compose: bool = True) -> Column:
    """A normalised span without punctuation at its edges."""
    return F.btrim(normalize(c, compose), F.lit(EDGES))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def segments(c: Column | str) -> Column:
    """Lines of the folded text."""
    return F.split(fold_punct(c), r"\n+", -1)


def outer_span(segment: Column | str) -> Column:
    """From the first to the last quotation mark, trimmed; null if there are not two."""
    inner = F.regexp_extract(col(segment), r'(?s)^[^"]*"(.*)"', 1)
    return F.when(col(segment).rlike(r'(?s)".*"'), trim_space(inner))


def quote_pairs(segment: Column | str) -> Column:
    """Spans between marks taken in pairs from the left, trimmed, of ``MIN_SPAN`` characters or more."""
    pairs = F.transform(F.regexp_extract_all(col(segment), F.lit(r'"([^"]*)"'), F.lit(1)), trim_space)
    return F.filter(pairs, lambda x: F.length(x) >= MIN_SPAN)


def cited_ids(c: Column | str) -> Column:
    """Distinct bracketed ids without brackets, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"\[([a-z0-9-]+#[^\]]*)\]"), F.lit(1)))


def base_id(c: Column | str) -> Column:
    """An id without its refinement in parentheses."""
    return F.regexp_extract(col(c), r"^([^(]*)", 1)


def render_citation(instrument: Column, citation: Column, basis: Column, date: Column) -> Column:
    """``instrument, citation (consolidated text as of D)`` or ``(act as published, D)``."""
    how = F.when(basis == "consolidation", F.concat(F.lit("consolidated text as of "), date)).otherwise(F.concat(F.lit("act as published, "), date))
    return F.concat(instrument, F.lit(", "), citation, F.lit(" ("), how, F.lit(")"))
