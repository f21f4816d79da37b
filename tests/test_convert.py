import pytest
from pyspark.sql import functions as F

from attesta.operators import convert
from attesta.sources import chunks as C
from attesta.sources import pages as P

PAGE = """<html><head><title>T</title></head><body><nav>menu</nav><h2 id="c1">CHAPTER I</h2><h2>General</h2><p>One (<sup>1</sup>) and x<sup>2</sup>.<p>Two&nbsp;<b>bold</i></p>
<ul><li>a<li>b</ul><table><tr><td rowspan="2">A|B</td><td colspan="2">C</td></tr><tr><td>D</td><td>E</td></tr><tr><td></td><td></td><td></td></tr></table><footer>f</footer></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")


def test_blocks(pages):
    rows = convert.convert(pages).orderBy("ord").collect()
    texts = [(r.kind, r.text) for r in rows if r.kind != "cell"]
    assert texts == [("heading", "CHAPTER I"), ("heading", "General"), ("paragraph", "One () and x^2."), ("paragraph", "Two bold"), ("point", "a"), ("point", "b")]
    assert {(r.row, r.col): r.text for r in rows if r.kind == "cell"} == {(0, 0): "A\\|B", (0, 1): "C", (0, 2): "", (1, 0): "", (1, 1): "D", (1, 2): "E"}


def test_every_text_is_accounted_for(pages):
    states = {r.state: r.chars for r in convert.disposition_report(convert.require_accounted(convert.dispositions(pages))).collect()}
    assert states["drop:navigation"] == 4 and states["drop:footer"] == 1 and states["drop:note-mark"] == 1 and "unaccounted" not in states


def test_headings_merge_and_markdown(pages):
    rows = convert.merged_headings(convert.convert(pages))
    text = convert.markdown(rows).first().text
    assert text.startswith("## CHAPTER I — General {#c1}\n\nOne") and "| A\\|B | C |  |\n| --- | --- | --- |\n|  | D | E |" in text


def test_front_matter_round_trip(spark):
    from pyspark.sql import functions as F

    text = "---\ntitle: A b: c\namended_by:\n  - x\n  - y\n---\n# Body\n"
    df = spark.createDataFrame([(text,), ("no head",)], "t string")
    head, body = P.front_matter(F.col("t"))
    a, b = df.select(head.alias("h"), body.alias("b")).collect()
    assert a.h == {"title": ["A b: c"], "amended_by": ["x", "y"]} and a.b == "# Body\n" and b.h is None and b.b == "no head"
    assert df.limit(1).select(P.with_front_matter(head, body).alias("x")).first().x == text


def test_currency_and_its_probes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    assert C.exit_code(C.currency(old, old)) == 0
    new = spark.createDataFrame([("a", "x"), ("c", "3")], "path string, sha256 string")
    report = C.currency(old, new)
    assert {r.path: r.status for r in report.collect()} == {"a": "DIFFERS", "b": "MISSING", "c": "UNINDEXED"} and C.exit_code(report) == 1


def test_duplicate_ids_are_fatal(spark):
    df = spark.createDataFrame([("a", None), ("a", "y")], "id string, x string")
    with pytest.raises(Exception, match="duplicate id a"):
        C.load_chunks(df, ["id", "x"]).collect()
    assert C.load_chunks(df.limit(1), ["id", "x"]).first().x == ""


def test_dates_and_identity(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("02016R0679-20160504", ""), (None, "OJ 4.5.2016")], "s string, t string")
    date, basis = P.document_date(F.col("s"), F.col("t"))
    assert [tuple(r) for r in df.select(date, basis).collect()] == [("2016-05-04", "consolidation"), ("2016-05-04", "publication")]
    with pytest.raises(Exception, match="identity differs"):
        df.limit(1).select(P.require_identity(F.col("s"), F.lit("x"))).collect()


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep" + "</b>" * 1000, "<p>" + "<b>" * 100_000 + "deep", "<ul><li>" * 50_000 + "deep", "<table><tr><td>" * 20_000 + "deep"])
def test_deep_markup_is_read(page):
    root = convert.parse(page)
    assert any("deep" in b[2] for b in convert.blocks(root))
    assert all(t.state for t in convert.texts(root))


def test_spans_end_at_the_limits_of_html():
    wide = convert.grid(convert.parse("<table><tr><td colspan=2000000>a</td><td>b</td></tr><tr><td rowspan=99999999999999999999>c</td><td rowspan=\u00b2>d</td></tr></table>").kids[0])
    assert len(wide[0]) == 1001 and wide[0][0] == "a" and wide[0][1000] == "b" and wide[1][:2] == ["c", "d"]


def test_markers_join_their_bodies():
    page = """<div class="grid-list"><div>(a)</div><div><p>first body</p><p>second line</p><div class="grid-list"><p>(i)</p><p>inner</p></div></div></div>
<table><tr><td>1.</td><td>one row</td></tr></table><table><tr><td>—</td><td><h2>T</h2></td></tr></table><table><tr><td>wide cell</td><td>x</td></tr></table>"""
    rows = [b[:3] for b in convert.blocks(convert.parse(page))]
    assert rows == [("point", 1, "(a) first body"), ("paragraph", 1, "second line"), ("point", 2, "(i) inner"), ("point", 1, "1. one row"), ("heading", 2, "T"), ("point", 1, "—"), ("cell", 0, "wide cell"), ("cell", 0, "x")]


def test_parts_are_selectable(spark):
    page = "<h1>Act</h1><p id='rct_1'>Whereas</p><p>more</p><h2 id='art_1'>Article 1</h2><p>text</p><h2 id='anx_I'>Annex I</h2><p>list</p>"
    rows = convert.parts(convert.convert(spark.createDataFrame([(1, page)], "page_id long, html string"))).orderBy("ord").collect()
    assert [(r.text, r.part) for r in rows] == [("Act", None), ("Whereas", "recitals"), ("more", "recitals"), ("Article 1", "enacting"), ("text", "enacting"), ("Annex I", "annexes"), ("list", "annexes")]


def test_unnumbered_siblings_have_an_owner(spark):
    rows = spark.createDataFrame([(1, 0, "heading", "H"), (1, 1, "paragraph", "1. one"), (1, 2, "paragraph", "more"), (1, 3, "heading", "I"), (1, 4, "paragraph", "none")], "doc_id long, ord int, kind string, text string")
    assert [r.owner for r in convert.nested(rows).orderBy("ord").collect()] == [None, "1", "1", None, None]


def test_raw_pages_and_their_manifest(spark, tmp_path):
    pages = spark.createDataFrame([(7, "u", "<title>T</title> 7 <p nonce=\"x\">02016R0679-20160504</p></body>"), (8, None, None)], "page_id long, url string, html string")
    P.write_raw(pages, str(tmp_path / "raw"), least=5)
    raw = spark.read.parquet(str(tmp_path / "raw/raw"))
    rows = {r.page_id: r for r in spark.read.json(str(tmp_path / "raw/manifest")).collect()}
    assert raw.count() == 2 and rows[7].doc_title == "T" and rows[7].stated_consolidation == "02016R0679-20160504" and rows[7].shape_problems == [] and rows[7].sha256 != rows[7].sha256_normalized
    assert rows[8].sha256 is None and len(rows[8].shape_problems) == 3


def test_dump_and_report(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "1#b", "Article 2", None, 9, 1200, "second"), (1, "1#a", "Article 1", "Act", 0, 5, "first")], "doc_id long, id string, citation string, parent_path string, offset long, chars int, body string")
    C.write_dump(chunks, str(tmp_path / "dump"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert lines[:6] == ["=" * 78, "1#a   [Article 1]   5 chars", "Act", "-" * 78, "first", ""] and lines[7] == "1#b   [Article 2]   1,200 chars"
    report = spark.createDataFrame([("a|b", 1), (None, 2)], "kind string, n int")
    assert [r.value for r in C.report_lines(report).orderBy("place", F.desc("value")).collect()] == ["| kind | n |\n| --- | --- |", "| a\\|b | 1 |", "|  | 2 |"]
    assert [r.id for r in C.read_jsonl(spark, [_written(C, chunks, str(tmp_path / "json"))], chunks.schema).orderBy("offset").collect()] == ["1#a", "1#b"]


def _written(sink, chunks, path):
    sink.write_jsonl(chunks, path, ["doc_id", "offset"])
    return path


def test_index_files_and_checks(spark, tmp_path):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    C.write_index(index, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2
    row = C.manifest(spark, "hashed", 64, 2, {"f": "h"}).first()
    assert (row.embed_model, row.dim, row.rows, row.chunk_files) == ("hashed", 64, 2, {"f": "h"})
    lex = spark.createDataFrame([(1, "a", 0), (2, "b", 9)], "question_id long, id string, lex_rank int")
    anchors = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, anchor string")
    assert {r.check: r.ok for r in C.smoke(index, 2, lex, anchors, lex.where("false")).collect()} == {"rows": True, "lexical": False, "dense": False}
    ids = spark.createDataFrame([("02016R0679-20160504",), ("02016R0679-20180525",), ("02017R0001-20170101",)], "id string")
    assert [r.id for r in P.versions_of(ids, "32016R0679").collect()] == ["02016R0679-20160504", "02016R0679-20180525"]
