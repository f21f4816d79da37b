"""From raw documents to packed sequences in five stages, each on all that the one before kept.

Every stage but the last returns the columns of its input.  The operators see doc_id, text and n_chars; all other columns of the
documents travel beside them under reserved names, so that no column's name can clash with an operator's own, and come out as they
went in.  The stages' docstrings say what becomes of a null or an empty text; null doc_ids and ties are legal everywhere: a null
counts as the smallest id.  Repeated rows (same id and text) are judged alike, and the near-duplicate stage keeps one of them.  An empty table
goes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import discard, owned, written
from attesta.llm.decontam import decontaminate
from attesta.llm.jaccard import keep_first
from attesta.llm.lines import line_dedup
from attesta.llm.packing import pack
from attesta.llm.quality import quality_rules


def carried(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` whose columns but for doc_id, text and n_chars go under reserved names; the result has the columns of ``docs``."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    inner = [c if c in ("doc_id", "text", "n_chars") else f"__carried_{i}" for i, c in enumerate(docs.columns)]
    out = work(docs.select(*[F.col(q).alias(i) for q, i in zip(quoted, inner)]))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; so do those without a text, which have too few words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return carried(docs, lambda d: quality_rules(d, labels).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of recurring line templates go; every document stays, and n_chars follows the text."""
    return carried(docs, line_dedup)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (5-word shingles, Jaccard 0.8) that of the smallest doc_id stays; documents without words all stay."""
    return carried(docs, lambda d: keep_first(d, n=5, percent=80))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 10 consecutive words of a benchmark item go."""
    return carried(docs, lambda d: decontaminate(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids; a document without a text is its end id."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", contamination),
    ("packing", packing),
]

#: The stages hash, sort along a curve and tokenize, which SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  The stages before run here, and each one's tables go when its result is stored."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with owned(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), own=False)
        if stored is not None:
            discard(stored)
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)
