import pytest

from attesta.operators import verify
from attesta.plans.session import check_answers

A, B = "The operator shall keep a register of all incidents.", "Members may inspect the register during office hours."


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(1, 0, "act-a#art_1", A), (1, 1, "act-a#art_2", B)], "question_id long, rank int, id string, body string")


def check(spark, sources, answer):
    a = spark.createDataFrame([(1, answer)], "question_id long, answer string")
    return check_answers(a, sources).first()


@pytest.mark.parametrize(
    "answer, verified",
    [
        (f'It says "{A}" [act-a#art_1].', True),
        (f"It says “{A[:-1]},” [act-a#art_1].", True),  # edge punctuation and curly quotes
        (f'First "{A}" and then "{B}" [act-a#art_2].', False),  # two real quotes on a line, the first cites the wrong chunk
        (f'First "{A}" [act-a#art_1] and then "{B}" [act-a#art_2].', True),
        (f'First "{A}" [act-a#art_1] and then "members can never inspect anything" [act-a#art_2].', False),  # a fake beside a real one
        (f'It says "{A.replace("all", "most")}" [act-a#art_1].', False),  # an altered word
        (f'It says "{A}" [act-a#art_2].', False),  # found, but the cited chunk lacks it
        (f'It says "{A}" [act-a#art_1(3)].', True),  # a refined id resolves to its base
        (f'It says "{A}" [act-z#art_1].', False),  # an unknown id
        (f'It says "{A}".', True),  # no id: unattributed, reported, not false
        ('It says "too short" [act-a#art_1].', True),
        ("No quote at all.", True),
    ],
)
def test_verification(spark, sources, answer, verified):
    assert check(spark, sources, answer).verified is verified


def test_first_source_in_rank_order(spark, sources):
    both = sources.unionByName(spark.createDataFrame([(1, 2, "act-a#copy", A)], sources.schema))
    a = spark.createDataFrame([(1, f'x "{A}"')], "question_id long, answer string")
    assert verify.read_segments(a, verify.normalized_sources(both)).first().source_id == "act-a#art_1"


def test_corpus_containment_short_and_long(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "xalpha beta gamma delta epsilon zetax"), (3, None)], "id long, text string")
    spans = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta."), (2, "beta gamma"), (3, "")], "span_id long, span string")
    got = {tuple(r) for r in verify.corpus_containment(spans, docs).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_large_and_small_sets_take_other_ways_to_the_same_rows(spark, monkeypatch):
    import random

    r = random.Random(3)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randint(0, 40))) for i in range(60)] + [(100, None)], "id long, text string")
    asked = [(i, text(r.choice([1, 2, 5, 6, 8]))) for i in range(25)] + [(90, "lph"), (91, "zzz"), (92, "")]
    spans = spark.createDataFrame(asked, "span_id long, span string")
    want = sorted((i, d.id) for i, s in asked for d in docs.collect() if s and d.text and s in d.text)
    assert sorted(tuple(x) for x in verify.corpus_containment(spans, docs).collect()) == want
    monkeypatch.setattr(verify, "ANCHORS", 2)
    monkeypatch.setattr(verify, "SHORT", 3)
    assert sorted(tuple(x) for x in verify.corpus_containment(spans, docs).collect()) == want
    assert sorted(tuple(x) for x in verify.indexed_containment(spans, docs).collect()) == want


def test_containment_by_index_with_folding_and_cut_words(spark, tmp_path):
    docs = [(1, "The “quick” brown ﬁx jumps [a-b#1] over"), (2, "xthe \"quick\" brown fix jumps over it"), (3, "the quick brown fix jumps over"), (4, None), (5, "…dots and—dashes, everywhere in it.")]
    spans = [(1, "the 'quick' brown"), (1, 'the "quick" brown fix jum'), (2, "he “quick” brown fix"), (3, "brown fix jumps over."), (4, "it"), (5, "dots and-dashes, every"), (6, None), (7, "brown nowhere fix here")]
    spark.createDataFrame(docs, "id long, text string").write.parquet(str(tmp_path / "docs"))
    d, s = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(spans, "span_id long, span string")
    want = sorted(tuple(x) for x in verify.corpus_containment(s, d).collect())
    assert want == sorted(tuple(x) for x in verify.indexed_containment(s, d).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 2), (4, 5), (5, 5)]


def test_plans_of_the_corpus_wide_legs(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    from attesta.operators import lexical

    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x")], "id long, text string")
    spans = spark.createDataFrame([(1, "a b c d e f"), (2, "x")], "question_id long, question string")

    def plan(df):
        with redirect_stdout(out := StringIO()):
            df.explain()
        return out.getvalue()

    assert "WindowGroupLimit" in plan(lexical.bm25_topk(docs, spans, 5))
    assert "NestedLoop" not in plan(verify.corpus_containment(spans, docs, "question_id", "question"))
