"""Interval and as-of joins and sweeps against plain loops, with one group that holds nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import evaluate
from attesta.operators.chunk import unclaimed
from attesta.operators.events import asof, covered


@pytest.fixture(scope="module")
def sides():
    r = random.Random(8)
    group = lambda: r.choice(["a"] * 8 + ["b", None])
    points = [(i, group(), None if r.random() < 0.05 else r.randrange(300)) for i in range(400)]
    spans = []
    for _ in range(60):
        lo = r.randrange(300)
        spans.append((group(), None if r.random() < 0.05 else lo, None if r.random() < 0.05 else lo + r.randrange(0, 6)))
    return points, spans


def test_covered(spark, sides):
    points, spans = sides
    p, s = spark.createDataFrame(points, "i long, g string, at int"), spark.createDataFrame(spans, "g string, lo int, hi int")
    got = {r.i: r.inside for r in covered(p, s, ["g"], "at", "lo", "hi").collect()}
    assert got == {i: any(h == g and at is not None and lo is not None and hi is not None and lo <= at < hi for h, lo, hi in spans) for i, g, at in points}
    assert {r.inside for r in covered(p, s.where("false"), ["g"], "at", "lo", "hi").collect()} == {False}


@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, sides, forward):
    points, spans = sides
    p, e = spark.createDataFrame(points, "i long, g string, at int"), spark.createDataFrame([(*s, k) for k, s in enumerate(spans)], "g string, t int, hi int, k int")
    got = {r.i: (r.k, r.hi) for r in asof(p, e, ["g"], "at", "t", ["k", "hi"], forward).collect()}
    for i, g, at in points:
        near = [(t if forward else -t, k, hi) for k, (h, t, hi) in enumerate(spans) if h == g and at is not None and t is not None and (t >= at if forward else t <= at)]
        assert got[i] == (min(near)[1:] if near else (None, None))


def test_a_document_of_many_paragraphs(spark):
    """A hundred thousand paragraphs of one document against as many chunks: pairs would be ten thousand million."""
    n = 100_000
    pars = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), (F.col("id") * 10).alias("offset"), F.lit("text").alias("par"))
    chunks = spark.range(n).where("id % 4 <> 0").select(F.lit(1).alias("doc_id"), (F.col("id") * 10).alias("offset"), F.lit(4).alias("chars"))
    got = unclaimed(pars, chunks)
    assert got.count() == n / 4 and got.where("pos % 4 <> 0").count() == 0


def test_sweep_of_one_sample(spark):
    """Two hundred thousand distinct scores of one sample, whose counts run over the stretches of a range sort."""
    n = 200_000
    scores = spark.range(n).select(F.lit("s").alias("sample"), (F.col("id") / n).alias("score"), (F.pmod(F.hash("id"), F.lit(100)) < F.col("id") * 100 / n).alias("positive"))
    out = evaluate.threshold_sweep(scores, ["sample"], budgets=(0, 50))
    rows = sorted((r.score, r.positive) for r in scores.collect())
    for r in out.collect():
        best, p, c = None, 0, 0
        for s, positive in rows:
            if p <= r.budget and (best is None or c > best[0]):
                best = (c, s, p)
            p, c = p + positive, c + (not positive)
        assert (r.caught, r.threshold, r.false_refusals) == best


def test_overlap(spark):
    rows = spark.createDataFrame([(1, 0.1, False), (2, 0.4, True), (3, 0.5, False), (4, 0.6, True)], "id long, score double, positive boolean")
    assert {r.id for r in evaluate.overlap(rows).collect()} == {2, 3}
    assert evaluate.overlap(rows.where("id <> 3")).count() == 0 and evaluate.overlap(rows.where("positive")).count() == 0
