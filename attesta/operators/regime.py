"""Closed-set membership: which named instruments a one-line reply declares, and the pre-flight verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import GENERAL, REFUSAL

EDGE = " .,:"


def closed_set(chunks: DataFrame, column: str = "instrument") -> DataFrame:
    """The distinct instruments that the index holds."""
    return chunks.where(F.col(column).isNotNull()).select(F.col(column).alias("instrument")).distinct()


def missing_aliases(instruments: DataFrame, aliases: DataFrame) -> DataFrame:
    """Instruments that the alias table (instrument, alias) has no row for."""
    return instruments.join(aliases, "instrument", "left_anti")


def require_total(instruments: DataFrame, aliases: DataFrame) -> DataFrame:
    """The alias table with canonical lower-case names; a row without an alias fails the job."""
    named = instruments.join(aliases.groupBy("instrument").agg(F.count(F.lit(1)).alias("n")), "instrument", "left")
    checked = named.select(F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no alias for "), "instrument")).cast("string")).otherwise(F.col("instrument")).alias("instrument"))
    return aliases.select("instrument", F.lower("alias").alias("alias")).unionByName(checked.select("instrument", F.lower("instrument").alias("alias"))).distinct()


def is_general(reply: Column) -> Column:
    """The whole reply is the sentinel, whatever its case and closing stops."""
    return F.rtrim(F.upper(F.trim(reply)), F.lit(".")) == GENERAL


def candidates(reply: Column) -> Column:
    """Each segment between semicolons, cleaned, with its gloss in parentheses apart: segment, what stands before the gloss, the gloss."""
    parts = F.filter(F.transform(F.split(reply, ";"), clean_segment), lambda s: s != "")
    gloss = r"^(.+?)\s*\(([^()]*)\)$"
    each = F.transform(parts, lambda s: F.array(s, F.when(s.rlike(gloss), clean_segment(F.regexp_extract(s, gloss, 1))), F.when(s.rlike(gloss), clean_segment(F.regexp_extract(s, gloss, 2)))))
    return F.array_distinct(F.array_compact(F.flatten(each)))


def clean_segment(s: Column) -> Column:
    flat = F.btrim(F.lower(F.regexp_replace(s, r"\s+", " ")), F.lit(EDGE))
    return F.regexp_replace(flat, r"^the\s+", "")


def declared(replies: DataFrame, aliases: DataFrame, rid: str = "reply_id", reply: str = "reply") -> DataFrame:
    """(reply_id, declared): sorted instruments of which a reply names an alias as an exact segment; replies without any have an empty array."""
    rows = replies.select(F.col(rid).alias("reply_id"), F.col(reply).alias("reply"))
    hits = rows.select("reply_id", F.explode(candidates(F.col("reply"))).alias("alias")).join(aliases, "alias").groupBy("reply_id").agg(F.sort_array(F.collect_set("instrument")).alias("declared"))
    return rows.select("reply_id").join(hits, "reply_id", "left").select("reply_id", F.coalesce("declared", F.array().cast("array<string>")).alias("declared"))


def declared_by_substring(replies: DataFrame, aliases: DataFrame, rid: str = "reply_id", reply: str = "reply") -> DataFrame:
    """The looser matcher: an alias anywhere in the reply, between other characters than letters and digits.

    The alias table is a closed set of documented names; a theta join against it is its definition.
    """
    rows = replies.select(F.col(rid).alias("reply_id"), F.lower(reply).alias("reply"))
    names = aliases.select("instrument", F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace("alias", r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"), F.lit("(?![a-z0-9])")).alias("pattern"))
    hits = rows.join(names, F.expr("reply rlike pattern")).groupBy("reply_id").agg(F.sort_array(F.collect_set("instrument")).alias("declared"))
    return rows.select("reply_id").join(hits, "reply_id", "left").select("reply_id", F.coalesce("declared", F.array().cast("array<string>")).alias("declared"))


def verdict(declared_: Column, reply: Column, strict: bool = False) -> Column:
    """``refuse`` if nothing of the closed set is declared; unless ``strict`` a general reply passes (fails open)."""
    none = F.size(declared_) == 0
    return F.when(none if strict else none & ~is_general(reply), "refuse").otherwise("pass")


def is_refusal(answer: Column) -> Column:
    """The fixed refusal stands within its own length and 40 characters from the start, in any case."""
    return F.contains(F.lower(F.substring(answer, 1, len(REFUSAL) + 40)), F.lit(REFUSAL.lower()))
