"""Chunk files in and out: JSON lines with an explicit schema, named file by file; the index, its manifest and its currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHUNK, FIELDS


def read_jsonl(spark: SparkSession, paths: list[str], schema=CHUNK) -> DataFrame:
    """Rows of named JSON-lines files; a missing file fails, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def unique_ids(df: DataFrame, id_: str = "id") -> DataFrame:
    """``df``; an id that occurs twice fails the job."""
    n = df.groupBy(id_).agg(F.count(F.lit(1)).alias("__n")).select(id_, F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col(id_).cast("string"))).cast("long")).otherwise(F.col("__n")).alias("__n"))
    return df.join(n, id_).where("__n = 1").drop("__n")


def load_chunks(df: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """The indexed columns in order, string nulls as empty strings, ids unique."""
    return unique_ids(df.select(*fields).na.fill(""))


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines sorted by ``order``, keys in alphabetical order, nulls kept."""
    df.select(*sorted(df.columns)).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def manifest(spark: SparkSession, embed_model: str, dim: int, rows: int, hashes: dict[str, str], written_by: str = "attesta") -> DataFrame:
    """One row that says what an index was built from."""
    from ..schema import INDEX_MANIFEST

    return spark.createDataFrame([(written_by, embed_model, dim, rows, hashes)], INDEX_MANIFEST)


def currency(recorded: DataFrame, current: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, status) of what an index recorded and what is there now, both (path, sha256): same, DIFFERS, MISSING, UNINDEXED or ORPHAN.

    known: the paths that the corpus is made of, those recorded by default.  A known path that isn't there is MISSING; one
    that the index lacks is UNINDEXED; one that the index holds and nobody knows any more is an ORPHAN, there or not.
    """
    j = recorded.select("path", F.col("sha256").alias("old")).join(current.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    if known is not None:
        j = j.join(known.select("path", F.lit(True).alias("known")).distinct(), "path", "full_outer").where("known or old is not null")
    mine = F.lit(True) if known is None else F.coalesce("known", F.lit(False))
    status = F.when(~mine, "ORPHAN").when(F.col("new").isNull(), "MISSING").when(F.col("old").isNull(), "UNINDEXED").when(F.col("old") == F.col("new"), "same").otherwise("DIFFERS")
    return j.select("path", status.alias("status"))


def embedder_status(stamp: DataFrame, embed_model: str, dim: int) -> DataFrame:
    """One row (path, status) beside those of :func:`currency`: does the index come from this embedder?  No stamp is UNVOUCHED."""
    agrees = (F.col("embed_model") == embed_model) & (F.col("dim") == dim)
    one = stamp.agg(F.count(F.lit(1)).alias("n"), F.min(agrees).alias("ok"))
    return one.select(F.lit("embedder").alias("path"), F.when(F.col("n") == 0, "UNVOUCHED").when(F.col("ok"), "same").otherwise("DIFFERS").alias("status"))


def exit_code(report: DataFrame, embedder_agrees: bool = True) -> int:
    """0 current, 1 stale, 2 nothing to compare."""
    r = report.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") != "same").cast("long")).alias("bad")).first()
    return 2 if not r.n else int(bool(r.bad) or not embedder_agrees)


def smoke(index: DataFrame, expected_rows: int, lexical: DataFrame, anchors: DataFrame, dense: DataFrame) -> DataFrame:
    """(check, ok): the row count, each identifier question finds its anchor among its five best, the dense leg isn't empty."""
    found = anchors.join(lexical.where("lex_rank < 5").select("question_id", F.col("id").alias("anchor"), F.lit(True).alias("hit")), ["question_id", "anchor"], "left").agg(F.min(F.coalesce("hit", F.lit(False))).alias("ok"))
    rows = index.agg((F.count(F.lit(1)) == expected_rows).alias("ok"))
    some = dense.agg((F.count(F.lit(1)) > 0).alias("ok"))
    return rows.select(F.lit("rows").alias("check"), "ok").unionByName(found.select(F.lit("lexical").alias("check"), "ok")).unionByName(some.select(F.lit("dense").alias("check"), "ok"))


def dump_lines(chunks: DataFrame, doc: str = "doc_id", order: str = "offset") -> DataFrame:
    """(doc, order, value): each chunk for reading, between rulers: id, citation and size, its path, its body."""
    rule = lambda c: F.repeat(F.lit(c), F.lit(78))
    head = F.concat(F.col("id"), F.lit("   ["), F.col("citation"), F.lit("]   "), F.format_number("chars", 0), F.lit(" chars"))
    return chunks.select(doc, order, F.concat_ws("\n", rule("="), head, F.coalesce("parent_path", F.lit("")), rule("-"), "body", F.lit("")).alias("value"))


def write_dump(chunks: DataFrame, path: str, doc: str = "doc_id", order: str = "offset") -> None:
    """All chunks as text, in order within and across files."""
    dump_lines(chunks, doc, order).repartitionByRange(doc, order).sortWithinPartitions(doc, order).select("value").write.mode("overwrite").text(path)


def report_lines(report: DataFrame) -> DataFrame:
    """(place, value): a report's rows as lines of a markdown table, place 0 the head; a null is an empty cell."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in report.columns]
    line = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    head = line([F.lit(c) for c in report.columns])
    rule = F.lit("|" + " --- |" * len(report.columns))
    top = report.sparkSession.range(1).select(F.lit(0).alias("place"), F.concat(head, F.lit("\n"), rule).alias("value"))
    return top.unionByName(report.select(F.lit(1).alias("place"), line(cells).alias("value")))
