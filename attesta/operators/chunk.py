"""Structural chunking of markdown by window functions: paragraphs, ancestors, marker runs, chunks, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .events import covered

HEADING = r"^(#{1,4})\s+(.*?)(?:\s*\{#([^}]*)\})?\s*$"
MARKER = r"^(?:(\d+[a-z]*)\.\s+|\((\w+)\)\s+)"
BLANKS = r"\n\s*\n"
WHOLE, CHAPEAU = 2000, 400


def _nullif(c: Column) -> Column:
    return F.when(c != "", c)


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text", separator: str = BLANKS) -> DataFrame:
    """(doc_id, pos, offset, par): non-blank paragraphs with the character offset at which they begin.

    Offsets count code points; leading and trailing newlines are not part of a paragraph's text, but the offset is that of the
    paragraph before they are taken off, as the separator leaves it.
    """
    parts, gaps = F.split(text, separator, -1), F.regexp_extract_all(text, F.lit(separator), F.lit(0))
    rows = docs.select(F.col(doc).alias("doc_id"), parts.alias("parts"), gaps.alias("gaps"))
    sizes = rows.select("doc_id", F.posexplode(F.transform("parts", lambda x, i: F.struct(x.alias("raw"), F.coalesce(F.length(F.get("gaps", i)), F.lit(0)).alias("gap")))).alias("pos", "x"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.select("doc_id", "pos", F.coalesce(F.sum(F.length("x.raw") + F.col("x.gap")).over(w), F.lit(0)).cast("long").alias("offset"), F.regexp_replace("x.raw", r"^\n+|\n+$", "").alias("par"))
    return out.where(F.trim(F.regexp_replace("par", r"\s+", " ")) != "")


def headings(pars: DataFrame) -> DataFrame:
    """``pars`` with level, title and anchor where a paragraph is a heading (one to four ``#``), else nulls."""
    is_heading = F.col("par").rlike(HEADING)
    part = lambda k: F.when(is_heading, _nullif(F.regexp_extract("par", HEADING, k)))
    return pars.withColumns({"level": F.length(part(1)), "title": F.when(is_heading, F.regexp_extract("par", HEADING, 2)), "anchor": part(3)})


def units(pars: DataFrame) -> DataFrame:
    """Headings and their blocks: ``headings(pars)`` with unit (running number), and the unit's own level, title, anchor and path.

    The path holds the ancestors' titles below level 1; an ancestor is the last heading of a smaller level, with none
    between whose level is smaller still.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    df = headings(pars) if "level" not in pars.columns else pars
    here = F.when(F.col("level").isNotNull(), F.struct("level", "title", "anchor"))
    df = df.withColumn("unit", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w)).withColumn("own", F.last(here, ignorenulls=True).over(w))
    for k in (2, 3):
        df = df.withColumn(f"h{k}", F.last(F.when(F.col("level") <= k, here), ignorenulls=True).over(w))
    keep = lambda k: F.when((F.col(f"h{k}.level") == k) & (F.col("own.level") > k), F.col(f"h{k}.title"))
    # a level-3 ancestor lies below the level-2 one: if a level-2 heading came later, h3 is that heading
    df = df.withColumn("path", F.array_compact(F.array(keep(2), keep(3))))
    return df.drop("h2", "h3")


def marker(par: Column) -> Column:
    """What a block at the margin begins with, ``1.`` or ``(a)``, as ``1`` or ``a``; else null."""
    return F.coalesce(_nullif(F.regexp_extract(par, MARKER, 1)), _nullif(F.regexp_extract(par, MARKER, 2)))


def kind(anchor: Column, path: Column, title: Column) -> Column:
    """The unit's kind, by the first rule that holds."""
    in_annex = F.exists(path, lambda p: p.rlike(r"(?i)^annex\b"))
    return (
        F.when(anchor.rlike(r"^(rct_|recital)") | title.rlike(r"^(?i:recital)\b"), "recital")
        .when(title.rlike(r"(?i)^article\b"), "article")
        .when(title.rlike(r"(?i)^annex\b"), "annex")
        .when(in_annex, "annex-section")
        .when(title.rlike(r"(?i)^section\b"), "section")
        .when(title.rlike(r"(?i)^(chapter|title|part)\b"), "division")
        .otherwise("other")
    )


def unit_number(title: Column) -> Column:
    """The number in the first pattern that fits the title."""
    patterns = (r"(?i)^recital\s+\(?(\d+)\)?", r"(?i)^annex\s+([ivxlc]+)\b", r"(?i)^article\s+(\d+[a-z]*)\b", r"(?i)^section\s+(\w+)\b")
    return F.coalesce(*[_nullif(F.regexp_extract(title, p, 1)) for p in patterns])


def runs(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks (by, pos, par) with marker, run (0 before the first marker) and the unit's total length and markers."""
    w = Window.partitionBy(*by).orderBy("pos")
    every = Window.partitionBy(*by)
    df = blocks.withColumn("marker", marker(F.col("par")))
    return df.withColumns({"run": F.count("marker").over(w), "total": F.sum(F.length("par")).over(every), "markers": F.count("marker").over(every)})


def split_decision(total: Column, markers: Column) -> Column:
    """A unit stays whole if it is short or has fewer than two markers; separators don't count."""
    return ~((total <= WHOLE) | (markers < 2))


def chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", separator: str = BLANKS) -> DataFrame:
    """Markdown documents to chunks: doc_id, id, kind, unit_number, marker, anchor, citation, parent_path, offset, chars, body, text.

    ``body`` is verbatim; ``text`` is path, chapeau and body.  A split unit gives one chunk a marker; a chapeau of at most
    ``CHAPEAU`` characters joins the first one's body and is repeated in the others' text, a longer one is a chunk of its own.
    """
    blocks = units(paragraphs(docs, doc, text, separator)).where("level is null and unit > 0")
    df = runs(blocks, ["doc_id", "unit"])
    lead = F.sum(F.when(F.col("run") == 0, F.length("par") + 2)).over(Window.partitionBy("doc_id", "unit")) - 2
    short = F.coalesce(lead <= CHAPEAU, F.lit(True))
    key = F.when(~split_decision(F.col("total"), F.col("markers")), F.lit(-1)).when((F.col("run") == 0) & short, F.lit(1)).otherwise(F.col("run")).cast("int")
    df = df.withColumns({"short": short, "key": key})
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["par"]), "\n\n")
    own = F.collect_list(F.struct("pos", "par"))
    first = F.collect_list(F.when(F.col("run") == 0, F.struct("pos", "par")))
    out = df.groupBy("doc_id", "unit", "key").agg(
        F.first("own").alias("own"), F.first("path").alias("path"), F.min("offset").alias("offset"), joined(own).alias("body"), joined(first).alias("lead"),
        F.min_by("marker", F.when(F.col("marker").isNotNull(), F.col("pos"))).alias("marker"), F.first("short").alias("short"),
    )
    unit_lead = F.max(F.when(F.col("short") & (F.col("key") == 1), F.col("lead"))).over(Window.partitionBy("doc_id", "unit"))
    out = out.withColumns({"marker": F.when(F.col("key") > 0, F.col("marker")), "chapeau": F.when(F.col("key") > 1, _nullif(unit_lead))})
    title, path = F.col("own.title"), F.col("path")
    out = out.withColumns({"kind": kind(F.coalesce("own.anchor", F.lit("")), path, title), "unit_number": unit_number(title)})
    roman = F.lower(F.regexp_extract(F.get(F.filter(path, lambda p: p.rlike(r"(?i)^annex\b")), 0), r"(?i)^annex\s+([ivxlc]+)", 1))
    slug = F.when(F.col("kind") == "annex-section", F.concat(F.lit("anx_"), roman, F.lit("_sct_"), F.coalesce("unit_number", F.lit("")))).otherwise(F.concat(F.lit("u"), F.col("unit").cast("string")))
    out = out.withColumn("anchor", F.coalesce("own.anchor", slug))
    part = F.concat(F.lit("("), "marker", F.lit(")"))
    base = F.when(F.col("kind") == "article", F.concat(F.lit("Article "), "unit_number")).when(F.col("kind") == "annex", F.concat(F.lit("Annex "), "unit_number")).when(F.col("kind") == "recital", F.concat(F.lit("Recital ("), "unit_number", F.lit(")"))).otherwise(F.col("unit_number"))
    citation = F.coalesce(_nullif(F.concat(F.coalesce(base, F.lit("")), F.coalesce(part, F.lit("")))), F.lit("—"))
    parent = F.array_join(F.array_append(path, title), " › ")
    text_ = F.concat_ws("\n\n", _nullif(parent), "chapeau", "body")
    return out.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), "anchor", F.coalesce(part, F.lit(""))).alias("id"), "kind", "unit_number", "marker", "anchor", citation.alias("citation"), parent.alias("parent_path"),
        "offset", F.length("body").alias("chars"), "body", text_.alias("text"),
    )


def duplicate_ids(chunks_: DataFrame) -> DataFrame:
    """(doc_id, id, n) of ids that occur twice or more in a document."""
    return chunks_.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage(chunks_: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, id, offset, chars, verbatim, in_order, status): each body against its source, at its offset and after the one before.

    Status: ok; out-of-order (verbatim, but begins before the former ends); moved (elsewhere in the source); absent.
    """
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("__src"))
    before = F.max(F.col("offset") + F.col("chars")).over(Window.partitionBy("doc_id").orderBy("offset", "id").rowsBetween(Window.unboundedPreceding, -1))
    df = chunks_.withColumn("in_order", F.coalesce(F.col("offset") >= before, F.lit(True))).join(src, "doc_id")
    df = df.withColumn("verbatim", F.substring(F.col("__src"), F.col("offset") + 1, F.col("chars")) == F.col("body"))
    status = F.when(F.col("verbatim") & F.col("in_order"), "ok").when(F.col("verbatim"), "out-of-order").when(F.contains("__src", "body"), "moved").otherwise("absent")
    return df.select("doc_id", "id", "offset", "chars", "verbatim", "in_order", status.alias("status"))


def unclaimed(pars: DataFrame, chunks_: DataFrame) -> DataFrame:
    """Non-heading paragraphs whose offset lies in no chunk: an anti join of points and intervals by one sort of both."""
    p = headings(pars).where("level is null").select("doc_id", "pos", "offset", "par")
    c = chunks_.select("doc_id", F.col("offset").alias("lo"), (F.col("offset") + F.col("chars")).alias("hi"))
    # written, since the range sort reads its input twice, to sample it first
    p, c = written(p, "points"), written(c, "intervals")
    out = covered(p, c, ["doc_id"], "offset", "lo", "hi").where("not inside").drop("inside")
    discard(p, c)  # the sort has written both
    return out


def size_report(chunks_: DataFrame) -> DataFrame:
    """(kind, n, smallest, median, p90, largest, over): sizes by kind; median and p90 are order statistics at n // 2 and int(0.9 n), from 0."""
    # chunks of a kind and size are counted before the shuffle; the window then runs over distinct sizes alone
    sizes = chunks_.groupBy("kind", "chars").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("kind")
    ranked = sizes.select("kind", "chars", "c", F.sum("c").over(w.orderBy("chars").rowsBetween(Window.unboundedPreceding, 0)).alias("r"), F.sum("c").over(w).alias("n"))
    at = lambda i: F.max(F.when((F.col("r") > i) & (F.col("r") - F.col("c") <= i), F.col("chars")))
    return ranked.groupBy("kind").agg(
        F.sum("c").alias("n"), F.min("chars").alias("smallest"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 9 / 10)).alias("p90"), F.max("chars").alias("largest"),
        F.sum((F.col("chars") > 4000).cast("long") * F.col("c")).alias("over"),
    )
