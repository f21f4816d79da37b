"""Reciprocal-rank fusion, reranking and the hybrid retrieval they make up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import Reranker, overlap_reranker
from ..sources.scratch import written

RRF = 60


def rrf(dense: DataFrame, lexical: DataFrame, k: int = 20) -> DataFrame:
    """(question_id, id, dense, rrf, rank from 0): both legs' 1 / (60 + rank) summed; ties keep dense, then lexical order.

    A hit of the lexical leg alone carries a similarity of 0.
    """
    both = dense.join(lexical, ["question_id", "id"], "full_outer")
    score = F.coalesce(1 / (RRF + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("lex_rank")), F.lit(0.0))
    both = both.withColumn("rrf", F.round(score, 9))
    order = Window.partitionBy("question_id").orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lex_rank"))
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("question_id", "id", F.coalesce("dense", F.lit(0.0)).alias("dense"), "rrf", (F.col("rank") - 1).alias("rank"))


def rerank(fused: DataFrame, questions: DataFrame, docs: DataFrame, keep: int = 5, *, reranker: Reranker = overlap_reranker, cid: str = "id", text: str = "text", qid: str = "question_id", qtext: str = "question") -> DataFrame:
    """The ``keep`` best of each question by the reranker's score, ties in fused order: adds ``rerank`` and ``place`` from 0.

    The few fused rows are written first, so that they go to the documents; else all texts would be shuffled to them.
    """
    pairs = written(fused, "fused").join(docs.select(F.col(cid).alias("id"), F.col(text).alias("__t")), "id").join(questions.select(F.col(qid).alias("question_id"), F.col(qtext).alias("__q")), "question_id")
    scored = pairs.withColumn("rerank", F.round(reranker(F.col("__q"), F.col("__t")), 6)).drop("__q", "__t")
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).withColumn("place", F.col("place") - 1)
