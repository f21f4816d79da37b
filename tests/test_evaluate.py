import random

import pytest

from attesta.operators import evaluate
from attesta.operators.dense import dense_topk
from attesta.operators.fuse import rrf


@pytest.fixture(scope="module")
def scores(spark):
    r = random.Random(4)
    rows = [("s", r.random() < 0.6, round(r.random(), 2), round(r.random(), 2)) for _ in range(80)]
    return rows, spark.createDataFrame(rows, "sample string, positive boolean, a double, b double")


def test_sweep_is_brute_force(scores):
    rows, df = scores
    got = {r.budget: (r.threshold, r.caught, r.false_refusals) for r in evaluate.threshold_sweep(df, ["sample"], "a").collect()}
    for budget in (0, 1, 2):
        best = None
        for t in [*sorted({x[2] for x in rows}), None]:
            below = [x for x in rows if t is None or x[2] < t]
            fr, c = sum(x[1] for x in below), sum(not x[1] for x in below)
            if fr <= budget and (best is None or c > best[1]):
                best = (t, c, fr)
        assert got[budget] == best


def test_or_sweep_is_brute_force(scores):
    rows, df = scores
    grid = [0.0, 0.1, 0.25, 0.5, 2.0]
    got = {r.budget: (r.t1, r.t2, r.caught) for r in evaluate.or_sweep(df, ["sample"], "a", "b", grid, grid).collect()}
    for budget in (0, 1, 2):
        every = [(-sum(not p for _, p, a, b in rows if a < x or b < y), x, y) for x in grid for y in grid if sum(p for _, p, a, b in rows if a < x or b < y) <= budget]
        c, x, y = min(every)
        assert got[budget] == (x, y, -c)


def test_floor(spark):
    df = spark.createDataFrame([(0.2, False), (0.4, False), (0.6, True)], "score double, positive boolean")
    r = evaluate.floor_gap(df).first()
    assert (r.max_out, r.min_in, r.floor, r.overlapping) == (0.4, 0.6, 0.5, 0)


def test_fusion_ties_and_lexical_only_hits(spark):
    dense = spark.createDataFrame([(1, "a", 0.9, 0), (1, "b", 0.8, 1)], "question_id long, id string, dense double, dense_rank int")
    lex = spark.createDataFrame([(1, "b", 5.0, 0), (1, "a", 4.0, 1), (1, "c", 3.0, 2)], "question_id long, id string, bm25 double, lex_rank int")
    got = rrf(dense, lex).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b", "c"] and got[2].dense == 0.0
    none = rrf(dense, lex.where("false")).orderBy("rank").collect()
    assert [r.id for r in none] == ["a", "b"]


def test_dense_is_the_same_in_any_partitioning(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 1.0, 0.0]), (2, None)], "question_id long, vector array<float>")
    want = sorted((-sum(a * b for a, b in zip(v, [1, 0, 1, 0])), i) for i, v in rows if v)[:7]
    for parts in (1, 5):
        got = [(-r.dense, r.id) for r in dense_topk(df.repartition(parts), q, 7).orderBy("dense_rank").collect()]
        assert got == want


def test_session_modes(spark):
    from attesta.plans.session import RagSession

    corpus = spark.createDataFrame([("a#1", "GDPR", "Article 1", "The controller keeps a record of processing activities.", "The controller keeps a record of processing activities."), ("a#2", "GDPR", "Article 2", "short", "short")], "id string, instrument string, citation string, body string, text string")
    q = spark.createDataFrame([(1, "controller record of processing activities"), (2, "zebra crossing")], "question_id long, question string")
    got = {r.question_id: r for r in RagSession(spark, corpus, floor=0.3).answer(q).collect()}
    assert got[1].mode == "answered" and got[1].verified and got[1].n_quotes == 1
    assert got[2].mode == "refused-gate" and got[2].verified
    aliases = spark.createDataFrame([("GDPR", "gdpr")], "instrument string, alias string")
    from pyspark.sql import functions as F

    strict = RagSession(spark, corpus, aliases, floor=None, preflight=lambda c: F.lit("Data Act")).answer(q)
    assert {r.mode for r in strict.collect()} == {"refused-preflight"}


def test_stream_gives_the_batch_answers(spark, tmp_path):
    from attesta.plans.session import RagSession
    from attesta.streaming.answers import answer_stream

    corpus = spark.createDataFrame([("a#1", "GDPR", "Article 1", "The controller keeps a record of processing activities.", "The controller keeps a record of processing activities.")], "id string, instrument string, citation string, body string, text string")
    q = spark.createDataFrame([(1, "controller record")], "question_id long, question string")
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    session = RagSession(spark, corpus, floor=0.1)
    answer_stream(stream, session, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("mode").collect() == session.answer(q).select("mode").collect()


def test_flips_that_nobody_meant_and_the_control_run(spark):
    flips = spark.createDataFrame([("q1", "pass", "refuse"), ("q2", "refuse", "pass")], "id string, before string, after string")
    intended = spark.createDataFrame([("q1",), ("q1",), ("q9",)], "id string")
    assert [r.id for r in evaluate.unintended_flips(flips, intended).collect()] == ["q2"]
    answers = spark.createDataFrame([(1, "answered", True), (2, "refused-gate", True), (3, "refused-generation", True), (4, "answered", False)], "question_id long, mode string, verified boolean")
    key = spark.createDataFrame([(1, "answer", None), (2, "refuse", "gate"), (3, "refuse", "gate"), (4, "refuse", "generation")], "question_id long, expected_behavior string, refusal_source string")
    assert tuple(evaluate.control_run(answers, key).first()) == (1, 1, 3, 1, 2, 3)


def test_score_sets_share_a_header(spark):
    a, b = spark.createDataFrame([(1, 0.5)], "id long, dense double"), spark.createDataFrame([(2, 0.25)], "id long, rerank double")
    assert sorted((r.sample, r.id, r.dense, r.rerank) for r in evaluate.collect_scores({"x": a, "y": b}).collect()) == [("x", 1, 0.5, None), ("y", 2, None, 0.25)]


def test_structure_checks(spark):
    from pyspark.sql import functions as F

    from attesta.operators import regime, validate, verify

    marked = spark.createDataFrame([(1, 0, 1, "A", "# A"), (1, 1, 2, "B", "## B"), (1, 2, None, None, "1. x"), (1, 3, None, None, "2a. y"), (1, 4, 2, "C", "## C")], "doc_id long, pos int, level int, title string, par string")
    assert [r.title for r in validate.empty_headings(marked).orderBy("pos").collect()] == ["A", "C"]
    assert [(r.heading, r.number) for r in validate.paragraph_numbers(marked).orderBy("pos").collect()] == [("B", "1"), ("B", "2a")]
    cells = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 0), (1, 1, 0, 0)], "doc_id long, table_no int, row int, col int")
    assert [(r.table_no, r.cells, r.height, r.width) for r in validate.grid_faults(cells).collect()] == [(0, 3, 2, 2)]
    ids = spark.createDataFrame([("a#1", "a#1|b#2"), ("b#2(3)", "a#1|b#2"), ("c", "a#1")], "cid string, anchors string")
    assert [r.m for r in ids.select(verify.base_matches(F.col("cid"), F.col("anchors")).alias("m")).collect()] == [True, True, False]
    assert regime.closed_set(spark.createDataFrame([("X",), ("X",), ("Y",)], "n string"), "n").count() == 2


def test_a_stream_leaves_nothing_in_the_shared_folder(spark, tmp_path):
    from pathlib import Path

    from attesta.sources import scratch

    before = set(Path(scratch.shared_dir(spark)).iterdir())
    with scratch.owned(spark):
        kept = scratch.written(spark.range(3), "inside", own=False)
        scratch.written(spark.range(3), "inside")
        scratch.discard(scratch.written(spark.range(3), "inside"))
    assert len(set(Path(scratch.shared_dir(spark)).iterdir()) - before) == 1
    scratch.discard(kept)
    assert set(Path(scratch.shared_dir(spark)).iterdir()) == before
