"""A versioned index: only what changed is built, a dead build changes nothing, and the stamp says who vouches."""

import pytest
from pyspark.sql import functions as F

from attesta.sources import chunks as C
from attesta.sources import snapshots as S


def table(spark, docs):
    return spark.createDataFrame(list(docs.items()), "path string, text string").withColumn("sha256", F.sha2("text", 256))


def words(seen=None, fail=None):
    def rows(fresh):
        if seen is not None:
            seen.append(sorted(r.path for r in fresh.select("path").collect()))
        if fail:
            raise fail
        return fresh.select("path", F.posexplode(F.split("text", " ")).alias("no", "word"))

    return rows


def served(spark, root):
    s = S.snapshot(spark, root)
    out = {}
    for r in s.rows.orderBy("path", "no").collect():
        out.setdefault(r.path, []).append(r.word)
    return {k: " ".join(v) for k, v in out.items()}


def test_builds(spark, tmp_path):
    root, seen = str(tmp_path / "ix"), []
    build = lambda docs, smoke=lambda rows: rows.count() > 0, **kw: S.build(spark, root, table(spark, docs), words(seen, **kw), smoke, "m", 4)
    docs = {"a": "one two", "b": "three", "c": "four five"}
    assert S.snapshot(spark, root) is None and S.stamp(spark, root).count() == 0
    assert build(docs) == S.Built(1, 3, 0, True) and served(spark, root) == docs
    # one changed document, one new, one gone: those alone are built
    docs = {"a": "one two", "b": "three and more", "d": "six"}
    assert build(docs) == S.Built(2, 2, 1, True) and seen[-1] == ["b", "d"] and served(spark, root) == docs
    assert S.stamp(spark, root).select("snapshot", "dim", "rows").collect() == [(2, 4, 6)]
    # nothing changed
    assert build(docs) == S.Built(3, 0, 0, True) and seen[-1] == [] and served(spark, root) == docs
    # a build that dies leaves the snapshot before it readable, and unvouched
    with pytest.raises(RuntimeError):
        build({**docs, "e": "x"}, fail=RuntimeError("killed"))
    assert S.versions(spark, root) == [1, 2, 3] and served(spark, root) == docs and S.stamp(spark, root).count() == 0
    assert C.embedder_status(S.stamp(spark, root), "m", 4).first().status == "UNVOUCHED"
    # the next takes its place; a failing smoke test leaves it without a stamp
    docs["e"] = "seven"
    assert build(docs, smoke=lambda rows: False) == S.Built(4, 1, 0, False) and served(spark, root) == docs and S.stamp(spark, root).count() == 0
    assert build(docs).passed and [C.embedder_status(S.stamp(spark, root), m, d).first().status for m, d in (("m", 4), ("n", 4), ("m", 8))] == ["same", "DIFFERS", "DIFFERS"]
    # an older snapshot can still be read, until compaction
    assert {r.path for r in S.snapshot(spark, root, 1).rows.collect()} == {"a", "b", "c"}
    S.compact(spark, root)
    assert S.versions(spark, root) == [6] and served(spark, root) == docs and S.snapshot(spark, root, 1) is None
    assert build({}, smoke=lambda rows: rows.count() == 0) == S.Built(7, 0, 4, True) and served(spark, root) == {}


def test_statuses(spark):
    f = lambda **kw: spark.createDataFrame(list(kw.items()), "path string, sha256 string")
    got = C.currency(f(a="1", b="1", c="1", d="1", e="1"), f(a="1", b="2", d="1", x="1", y="1"), f(a="", b="", c="", x="", z=""))
    assert {r.path: r.status for r in got.collect()} == {"a": "same", "b": "DIFFERS", "c": "MISSING", "d": "ORPHAN", "e": "ORPHAN", "x": "UNINDEXED", "z": "MISSING"}
    assert C.exit_code(got) == 1
