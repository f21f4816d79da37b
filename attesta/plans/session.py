"""Questions to verified answers, a DataFrame at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import REFUSAL, Embedder, Reranker, extractive_chat, hashed_embedder, overlap_reranker
from ..operators import dense as D
from ..operators import fuse, lexical, regime, verify
from ..sources.scratch import written


def pack_context(kept: DataFrame, docs: DataFrame, cid: str = "id", cite: str = "citation", body: str = "body") -> DataFrame:
    """(question_id, context): ``[id] citation`` and body of each source, in place order, parted by blank lines."""
    rows = kept.join(docs.select(F.col(cid).alias("id"), F.col(cite).alias("__c"), F.col(body).alias("__b")), "id")
    one = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), "__c", F.lit("\n"), "__b")
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("x")))), lambda s: s["x"]), "\n\n").alias("context"))


@dataclass
class RagSession:
    """A corpus (id, instrument, citation, date_basis, version_date, body, text, and a vector or none) and the models that read it.

    What several steps read (a few rows a question) is written to the shared folder, which also keeps plans short.
    The gate stands before rerank, pre-flight and generation, so what it refuses costs no model call.  ``preflight`` maps a question
    column to the one-line reply about instruments; without it every question passes.  ``aliases`` is (instrument, alias).
    """

    spark: SparkSession
    corpus: DataFrame
    aliases: DataFrame | None = None
    embedder: Embedder = field(default_factory=hashed_embedder)
    reranker: Reranker = overlap_reranker
    chat: object = extractive_chat
    preflight: object | None = None
    floor: float | None = 0.59
    k: int = 20
    keep: int = 5
    strict: bool = False

    def _vectors(self) -> DataFrame:
        return self.corpus if "embedding" in self.corpus.columns else self.corpus.withColumn("embedding", self.embedder(F.col("text")))

    def dense(self, questions: DataFrame) -> DataFrame:
        asked = questions if "vector" in questions.columns else questions.withColumn("vector", self.embedder(F.col("question")))
        return D.dense_topk(self._vectors(), asked, 2 * self.k)

    def dense_score(self, questions: DataFrame) -> DataFrame:
        """(question_id, best): what the gate looks at."""
        return D.best_dense(questions, self.dense(questions))

    def fused(self, questions: DataFrame, hits: DataFrame | None = None) -> DataFrame:
        lex = lexical.bm25_topk(self.corpus, questions, 2 * self.k)
        return fuse.rrf(self.dense(questions) if hits is None else hits, lex, self.k)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """(question_id, id, dense, rrf, rank, rerank, place) of the kept sources."""
        return fuse.rerank(self.fused(questions), questions, self.corpus, self.keep, reranker=self.reranker)

    def answer(self, questions: DataFrame) -> DataFrame:
        """(question_id, question, mode, answer, best_dense, declared, n_quotes, n_missed, n_unknown, n_wrong, verified).

        Refusals of gate and pre-flight are verified by default: they claim nothing.
        """
        hits = written(self.dense(questions), "hits")
        best = D.gate(D.best_dense(questions, hits), self.floor)
        asked = questions.join(best, "question_id")
        passed = written(asked.where("not refused"), "passed")
        none = F.array().cast("array<string>")
        if self.preflight is None:
            passed = passed.withColumns({"declared": none, "verdict": F.lit("pass")})
        else:
            passed = passed.withColumn("reply", self.preflight(F.col("question")))
            said = regime.declared(passed, self.aliases, "question_id")
            passed = passed.join(said.withColumnRenamed("reply_id", "question_id"), "question_id").withColumn("verdict", regime.verdict(F.col("declared"), F.col("reply"), self.strict)).drop("reply")
            passed = written(passed, "verdicts")
        go = passed.where("verdict = 'pass'")
        kept = fuse.rerank(self.fused(go, hits.join(go.select("question_id"), "question_id", "left_semi")), go, self.corpus, self.keep, reranker=self.reranker)
        sources = written(kept.join(self.corpus.select("id", "body"), "id").select("question_id", F.col("place").alias("rank"), "id", "body"), "sources")
        first = sources.where("rank = 0").select("question_id", F.col("id").alias("__id"), F.col("body").alias("__body"))
        said = go.join(first, "question_id", "left").withColumn("answer", F.coalesce(self.chat(F.col("__id"), F.col("__body")), F.lit(REFUSAL))).drop("__id", "__body")
        said = written(said, "answers")
        checks = check_answers(said, sources)
        done = said.join(checks, "question_id").withColumn("mode", F.when(regime.is_refusal(F.col("answer")), "refused-generation").otherwise("answered"))
        cols = ["question_id", "question", "mode", "answer", F.col("best").alias("best_dense"), "declared", "n_quotes", "n_missed", "n_unknown", "n_wrong", "verified"]
        zero, no = F.lit(0).cast("long"), F.lit(None).cast("string")
        blank = {"answer": no, "n_quotes": zero, "n_missed": zero, "n_unknown": zero, "n_wrong": zero, "verified": F.lit(True)}
        gated = asked.where("refused").withColumns({**blank, "declared": none, "mode": F.lit("refused-gate")})
        stopped = passed.where("verdict = 'refuse'").withColumns({**blank, "mode": F.lit("refused-preflight")})
        return done.select(*cols).unionByName(gated.select(*cols)).unionByName(stopped.select(*cols))


def check_answers(answers: DataFrame, sources: DataFrame, text: str = "answer") -> DataFrame:
    """(question_id, n_quotes, n_missed, n_unknown, n_wrong, verified) of answers against their sources (question_id, rank, id, body)."""
    norm = written(verify.normalized_sources(sources), "bodies")
    quotes = written(verify.read_segments(answers, norm, text=text), "quotes")
    ids = written(verify.classify_ids(answers, norm, text=text), "ids")
    wrong = verify.misattributed(verify.attribution(answers, quotes, norm, text=text))
    return verify.verified(answers, quotes, ids, wrong)


def sentinel(context: Column, mark: str) -> Column:
    """The context with a mark after its last chunk, to see that it comes back whole."""
    return F.concat(context, F.lit("\n"), F.lit(mark))
