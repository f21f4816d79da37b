"""Trees as intervals against a walk over the parsed page, and the structural walk over an act written by hand."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import convert, tree

ACT = """<html><head><style>p {}</style></head><body><div class="eli-container">
<p class="oj-hd-ti">REGULATION 2024/1</p><p class="disclaimer">No legal effect</p>
<table class="hd-modifiers"><tr><td>Corrected by:</td><td><a href="/legal-content/?uri=celex:32024R0001">B</a> <a href="/celex/32024R0001R%2802%29">C1</a> <a href="/celex/32024R0001">again</a></td></tr></table>
<div id="pbl_1"><div id="rct_1"><table><tr><td>(1)</td><td>Whereas this is so.</td></tr></table></div><div id="rct_2"><p>(2)</p><p>And that.</p></div></div>
<div id="enc_1"><p class="modref">M1</p>
<div id="cpt_I"><p class="title-division-1">CHAPTER I</p><p class="title-division-2">GENERAL <i>PROVISIONS</i></p>
<div id="art_1"><p class="title-article-norm">Article 1</p><p class="stitle-article-norm">Subject</p><p>1. One.</p><p class="footnote">inside the article</p></div>
<div id="art_4a"><p class="oj-ti-art">Article 4a</p><p>No title here.</p></div></div>
<div id="cpt_I.sct_2"><p class="oj-ti-section-1">SECTION 2</p></div><p class="title-division-2">Alone</p>
<div id="fnp_1"><p>Done at Brussels.</p></div>
<div id="anx_III"><p class="title-annex-1">ANNEX III</p><p class="title-annex-1">High <b>risk</b></p><p>Items.</p></div><div id="anx_IV"><p>No label.</p></div>
<p class="oj-note">(1) A note.</p><p>left over</p></div></div></body></html>"""


def test_intervals(spark):
    pages = [(1, ACT), (2, None), (3, ""), (4, "<p>a<b>b</p>c<br><i></i>"), (5, "<div>" * 3000 + "x")]
    got = {}
    for r in tree.page_tree(spark.createDataFrame(pages, "page_id long, html string")).collect():
        got.setdefault(r.doc_id, {})[r.pre] = r
    assert set(got) == {1, 4, 5}
    for d, page in pages:
        if d not in got:
            continue
        nodes = list(convert.descend(convert.parse(page)))
        number = {id(n): i for i, n in enumerate(nodes)}
        assert len(nodes) == len(got[d])
        for i, n in enumerate(nodes[:400]):
            r = got[d][i]
            below = sum(1 for _ in convert.descend(n))
            assert (r.tag, r.text, r.last) == (n.tag, n.text, i + below) and r.up == number.get(id(n.up))
    assert got[5][3000].depth == 3000


def test_under_and_outermost(spark):
    nodes = tree.page_tree(spark.createDataFrame([(1, "<div id=a><p>x</p><div id=a2><i>y</i></div></div><p>z</p><div id=a3>w</div>")], "page_id long, html string"))
    tops = nodes.where("ident = 'a'")
    texts = nodes.where("text is not null")
    assert [r.text for r in texts.join(tree.under(texts, tops), ["doc_id", "pre"]).orderBy("pre").collect()] == ["x", "y"]
    own = tree.outermost(nodes, F.startswith("ident", F.lit("a")))
    at = {r.ident: r.pre for r in nodes.where("ident is not null").collect()}
    assert {r.text: r.owner for r in own.where("text is not null").collect()} == {"x": at["a"], "y": at["a"], "z": None, "w": at["a3"]}
    assert {r.ident: r.owner for r in own.where("ident is not null").collect()} == {"a": at["a"], "a2": at["a"], "a3": at["a3"]}


@pytest.fixture(scope="module")
def act(spark):
    return tree.page_tree(spark.createDataFrame([(1, ACT)], "page_id long, html string")).cache()


def test_enacting_terms(act):
    rows = [tuple(r) for r in tree.structural_walk(act).orderBy("ord").select("role", "number", "heading", "anchor", "text").collect()]
    plain = [r for r in rows if not r[0].startswith("drop:")]
    assert plain == [
        ("division", None, "CHAPTER I — GENERAL PROVISIONS", None, "CHAPTER I"),
        ("article", "1", "Article 1 — Subject", "art_1", "Article 1Subject1. One.inside the article"),
        ("article", "4a", "Article 4a", "art_4a", "Article 4aNo title here."),
        ("division", None, "SECTION 2 — Alone", None, "SECTION 2"),
        ("formula", "1", None, "fnp_1", "Done at Brussels."),
        ("annex", "III", "ANNEX III — High risk", "anx_III", "ANNEX IIIHigh riskItems."),
        ("annex", "IV", "ANNEX IV", "anx_IV", "No label."),
        ("footnote", None, None, None, "(1) A note."),
        ("unaccounted", None, None, None, "left over"),
    ]
    dropped = [(r[0], r[4]) for r in rows if r[0].startswith("drop:")]
    assert dropped == [
        ("drop:script", "p {}"), ("drop:title", "REGULATION 2024/1"), ("drop:disclaimer", "No legal effect"), ("drop:modifiers-toc", "Corrected by:B C1 again"),
        ("drop:not-this-part", "(1)Whereas this is so."), ("drop:not-this-part", "(2)And that."), ("drop:amendment-marker", "M1"),
    ]


def test_recitals(act):
    rows = [tuple(r) for r in tree.structural_walk(act, "recitals").orderBy("ord").select("role", "number", "anchor", "text").collect()]
    assert [r for r in rows if r[0] in ("recital", "footnote", "unaccounted")] == [("recital", "1", "rct_1", "(1)Whereas this is so."), ("recital", "2", "rct_2", "(2)And that."), ("footnote", None, None, "(1) A note."), ("unaccounted", None, None, "left over")]
    assert {r[0] for r in rows if r[3].startswith(("Article", "ANNEX", "CHAPTER", "Done"))} == {"drop:not-this-part"}


def test_every_text_is_in_one_row(act):
    for part in ("enacting", "recitals"):
        walked = tree.structural_walk(act, part).agg(F.sum(F.length(F.regexp_replace("text", r"\s", "")))).first()[0]
        there = act.where("text is not null").agg(F.sum(F.length(F.regexp_replace("text", r"\s", "")))).first()[0]
        titles = sum(len(t.replace(" ", "")) for t in ("GENERAL PROVISIONS", "Alone")) if part == "enacting" else 0
        assert walked == there - titles  # a division's title stands in its heading


def test_nodes_are_read_once(spark):
    nodes = tree.page_tree(spark.createDataFrame([(1, ACT)], "page_id long, html string"))
    plan = tree.structural_walk(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_every_label_of_an_annex(spark):
    labels = "".join(f'<p class="oj-doc-ti">L{i} </p>' for i in range(1500))
    nodes = tree.page_tree(spark.createDataFrame([(1, f'<div id="anx_I">{labels}</div>')], "page_id long, html string"))
    assert [r.heading for r in tree.structural_walk(nodes).collect()] == ["L0 — " + " ".join(f"L{i}" for i in range(1, 1500))]


def test_modifying_acts(spark, act):
    assert [tuple(r) for r in tree.modifying_acts(act).collect()] == [(1, "corrected_by", ["32024R0001", "32024R0001R(02)"])]
    other = tree.page_tree(spark.createDataFrame([(2, "<p>x <a href='?uri=celex:32026R1744'>y</a></p>"), (3, "<p>none</p>")], "page_id long, html string"))
    assert sorted(tuple(r) for r in tree.modifying_acts(other).collect()) == [(2, "amended_by", ["32026R1744"]), (3, "amended_by", [])]
