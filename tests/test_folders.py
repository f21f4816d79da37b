"""Folders as data sources: batch and stream give equal rows, and what is not asked for is not opened."""

import hashlib
import json

import pytest

from attesta.sources.folders import MarkdownFolder, PageFolder, front_matter, markdown_files


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    spark.dataSource.register(PageFolder)
    spark.dataSource.register(MarkdownFolder)


def add(folder, ids, **other):
    with open(folder / "manifest.jsonl", "a") as f:
        for i in ids:
            html = f"<p>page {i} ü</p>"
            (folder / f"{i}.html").write_text(html)
            f.write(json.dumps({"page_id": i, "url": f"https://x/{i % 3}", "file": f"{i}.html", "sha256": hashlib.sha256(html.encode()).hexdigest(), **other}) + "\n")


def run(spark, stream, out, checkpoint):
    """What a run of the stream adds."""
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(out)).collect())


def test_pages(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    add(folder, range(150))
    batch = spark.read.format("attesta_pages").load(str(folder))
    rows = sorted(tuple(r) for r in batch.collect())
    assert len(rows) == 150 and rows[7][:3] == (7, "https://x/1", "7.html") and rows[7][4] == "<p>page 7 ü</p>"
    assert batch.rdd.getNumPartitions() == 3
    # files that aren't asked for needn't even be there
    for i in range(10, 150):
        (folder / f"{i}.html").unlink()
    some = lambda **only: spark.read.format("attesta_pages").option("only", json.dumps(only)).load(str(folder))
    assert sorted(r.page_id for r in some(page_id=list(range(10)), url=["https://x/1"]).collect()) == [1, 4, 7]
    few = some(page_id=[2, 3])
    assert [r.html for r in few.orderBy("page_id").collect()] == ["<p>page 2 ü</p>", "<p>page 3 ü</p>"] and few.where("page_id = 2").count() == 1 and few.count() == 2
    with pytest.raises(Exception, match="10.html|No such file"):
        batch.collect()
    (folder / "3.html").write_text("other")
    with pytest.raises(Exception, match="not what the manifest says"):
        few.collect()
    with pytest.raises(Exception, match="not known before"):
        some(html=["x"]).count()


def test_a_stream_of_pages(spark, tmp_path):
    folder, checkpoint = tmp_path / "pages", tmp_path / "checkpoint"
    folder.mkdir()
    add(folder, range(5))
    stream = spark.readStream.format("attesta_pages").load(str(folder))
    batch = lambda: sorted(tuple(r) for r in spark.read.format("attesta_pages").load(str(folder)).collect())
    assert run(spark, stream, tmp_path / "out", checkpoint) == batch()
    add(folder, range(5, 9))
    with open(folder / "manifest.jsonl", "a") as f:
        f.write('{"page_id": 99')  # a line that is still being written
    # goes on where it ended: the new pages alone
    assert run(spark, stream, tmp_path / "out", checkpoint) == batch() and len(batch()) == 9


def test_markdown(spark, tmp_path):
    folder, checkpoint = tmp_path / "md", tmp_path / "checkpoint"
    folder.mkdir()
    (folder / "01.md").write_text('---\ntitle: "A: b"\ndate: 2024-01-02\n---\n\n# One\n')
    (folder / "02.md").write_text("no front matter")
    (folder / "notes.txt").write_text("not read")
    batch = spark.read.format("attesta_markdown").load(str(folder))
    rows = sorted((r.file, r.meta, r.body) for r in batch.collect())
    assert rows == [("01.md", {"title": "A: b", "date": "2024-01-02"}, "# One\n"), ("02.md", {}, "no front matter")]
    assert [r.body for r in spark.read.format("attesta_markdown").option("only", '{"file": ["02.md"]}').load(str(folder)).collect()] == ["no front matter"]
    stream = spark.readStream.format("attesta_markdown").load(str(folder)).select("file", "body")
    assert run(spark, stream, tmp_path / "out", checkpoint) == [(f, b) for f, _, b in rows]
    (folder / "03.md").write_text("third")
    assert run(spark, stream, tmp_path / "out", checkpoint)[2:] == [("03.md", "third")]
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("attesta_markdown").load(str(empty)).count() == 0 and markdown_files(str(empty)) == []


def test_front_matter():
    assert front_matter("---\na: 1\n# c\n b: 2\n---\nx") == ({"a": "1"}, "x")
    assert front_matter("---\na: 1\nnever ended") == ({}, "---\na: 1\nnever ended") and front_matter("") == ({}, "")
