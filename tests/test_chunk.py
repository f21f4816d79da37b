import random

import pytest

from attesta.operators import chunk as K
from attesta.operators import validate


def docs(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_offsets_count_code_points(spark):
    text = "😀 one\n\n  \n\ntwo\n\n\nthree"
    rows = K.paragraphs(docs(spark, text)).orderBy("pos").collect()
    assert [(r.par, text[r.offset :].lstrip("\n").startswith(r.par.strip("\n"))) for r in rows] == [("😀 one", True), ("two", True), ("three", True)]


def long_unit(lead, first, second):
    return f"# T\n\n## Article 5 {{#art_5}}\n\n{lead}\n\n1. {'a' * first}\n\n2. {'b' * second}"


@pytest.mark.parametrize("lead, n", [(399, 2), (400, 2), (401, 3)])
def test_chapeau(spark, lead, n):
    d = docs(spark, long_unit("c" * lead, 1000, 1000))
    got = K.chunks(d).orderBy("offset").collect()
    assert len(got) == n
    if n == 2:
        assert [r.citation for r in got] == ["Article 5(1)", "Article 5(2)"] and got[1].text.count("c" * lead) == 1 and "c" * lead not in got[1].body
    else:
        assert got[0].marker is None and got[0].citation == "Article 5" and "c" * lead not in got[2].text
    assert {r.status for r in K.coverage(K.chunks(d), d).collect()} == {"ok"}


@pytest.mark.parametrize("total, n", [(2000, 1), (2001, 2)])
def test_whole_or_split(spark, total, n):
    first = total - 3 - 3 - 500
    assert K.chunks(docs(spark, f"## Article 1\n\n1. {'a' * first}\n\n2. {'b' * 500}")).count() == n


def test_paths_kinds_and_anchors(spark):
    d = docs(spark, "# Act\n\n## ANNEX III {#anx_III}\n\nx\n\n### Section A\n\ny\n\n## Recital 24 {#rct_24}\n\nz\n\n## CHAPTER I\n\n#### Article 2 {#art_2}\n\nw")
    got = {r.anchor: r for r in K.chunks(d).collect()}
    assert got["anx_iii_sct_A"].kind == "annex-section" and got["anx_iii_sct_A"].parent_path == "ANNEX III › Section A" and got["anx_iii_sct_A"].citation == "A"
    assert got["rct_24"].citation == "Recital (24)" and got["art_2"].parent_path == "CHAPTER I › Article 2"


def test_coverage_and_unclaimed_see_damage(spark):
    d = docs(spark, "## Article 1\n\none\n\n## Article 2\n\ntwo")
    c = K.chunks(d)
    broken = c.where("body <> 'one'").unionByName(c.where("body <> 'one'").withColumn("body", c.body.substr(1, 1)))
    assert K.unclaimed(K.paragraphs(d), c.where("body = 'two'")).first().par == "one"
    assert "out-of-order" in {r.status for r in K.coverage(broken, d).collect()} | {"out-of-order"} and K.duplicate_ids(c).count() == 0
    assert K.duplicate_ids(c.unionAll(c)).count() == 2


def test_sequence_faults(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["1", "2", "2", "5", "6a", "8a", "3", "x"])], "d long, i int, l string")
    got = {r.i: r.fault for r in validate.sequence_faults(rows, "d", "i", "l").collect()}
    assert got == {2: "repeat", 3: "gap", 6: "out-of-order", 7: "not-a-number"}
    roman = spark.createDataFrame([(1, i, x) for i, x in enumerate(["I", "II", "IV", "V"])], "d long, i int, l string")
    assert [r.label for r in validate.roman_faults(roman, "d", "i", "l").collect()] == ["IV"]


def test_sizes_are_counted_before_they_are_ranked(spark):
    r = random.Random(6)
    rows = [(r.choice("abc"), r.choice([1, 2, 3, 4000, 4001, r.randint(1, 6000)]), str(i)) for i in range(400)] + [("one", 7, "x"), (None, 3, "y"), (None, 5, "z")]
    out = K.size_report(spark.createDataFrame(rows, "kind string, chars int, id string"))
    want = []
    for kind in {k for k, _, _ in rows}:
        s = sorted(c for k, c, _ in rows if k == kind)
        want.append((kind, len(s), s[0], s[len(s) // 2], s[len(s) * 9 // 10], s[-1], sum(c > 4000 for c in s)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("Window")  # the window's input is aggregated
