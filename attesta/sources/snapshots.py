"""A versioned index: each build adds a snapshot of what changed, and is seen only once it is whole.

    root/delta/<n>          the rows of documents that are new or changed in snapshot n
    root/entries/<n>        (path, sha256, origin) of every document that snapshot n serves; origin: the snapshot that holds its rows
    root/committed/<n>      an empty marker, moved into place last
    root/stamp              what the index was built from, there only while a smoke test vouches for it

A build removes the stamp first and writes it after the smoke test, so an index is vouched for or it isn't; a build that dies
leaves the last snapshot as it was, and what it has written is overwritten by the next.  A document that has gone has no entry any more; its rows stay
in their delta, which no entry names, until :func:`compact`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import manifest

ENTRY = "path string, sha256 string, origin int"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed snapshots, oldest first."""
    fs, p = _fs(spark, f"{root}/committed")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def _commit(spark: SparkSession, root: str, n: int) -> None:
    """A marker is written under another name and moved: it is there or it isn't."""
    fs, draft = _fs(spark, f"{root}/committed/_{n}")
    fs.mkdirs(draft.getParent())
    fs.create(draft, True).close()
    if not fs.rename(draft, _fs(spark, f"{root}/committed/{n}")[1]):
        raise RuntimeError(f"snapshot {n} could not be committed")


@dataclass(frozen=True)
class Snapshot:
    n: int
    entries: DataFrame
    rows: DataFrame


def snapshot(spark: SparkSession, root: str, n: int | None = None) -> Snapshot | None:
    """The last committed snapshot, or that of number ``n``; None where there is none."""
    known = versions(spark, root)
    if not known or (n is not None and n not in known):
        return None
    n = known[-1] if n is None else n
    entries = spark.read.schema(ENTRY).parquet(f"{root}/entries/{n}")
    origins = sorted(r.origin for r in entries.select("origin").distinct().collect())
    rows = None
    for o in origins or known[-1:]:
        # an old delta's rows are served where this snapshot still names it
        own = spark.read.parquet(f"{root}/delta/{o}").join(entries.where(F.col("origin") == o).select("path"), "path", "left_semi")
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return Snapshot(n, entries, rows)


@dataclass(frozen=True)
class Built:
    n: int
    changed: int
    gone: int
    passed: bool


def build(
    spark: SparkSession, root: str, docs: DataFrame, rows: Callable[[DataFrame], DataFrame], smoke: Callable[[DataFrame], bool], embed_model: str, dim: int, path: str = "path", sha256: str = "sha256"
) -> Built:
    """Adds a snapshot that serves ``docs``: (path, sha256, and what ``rows`` reads), one row a document.

    ``rows`` makes the index rows (path, ...) of the documents it is given, chunks and vectors: it gets those alone whose content is new or
    changed.  ``smoke`` reads the new snapshot's rows.  A failing test leaves the snapshot served but without a stamp, as an interrupted build does.
    """
    _delete(spark, f"{root}/stamp")
    old = snapshot(spark, root)
    n = (old.n if old else 0) + 1
    now = docs.select(F.col(path).alias("path"), F.col(sha256).alias("sha256"))
    before = old.entries if old else spark.createDataFrame([], ENTRY)
    same = now.join(before, ["path", "sha256"])
    entries = same.select("path", "sha256", "origin").unionByName(now.join(before, ["path", "sha256"], "left_anti").select("path", "sha256", F.lit(n).alias("origin")))
    entries.write.mode("overwrite").parquet(f"{root}/entries/{n}")
    entries = spark.read.schema(ENTRY).parquet(f"{root}/entries/{n}")
    fresh = docs.join(entries.where(F.col("origin") == n).select(F.col("path").alias(path)), path, "left_semi")
    rows(fresh).write.mode("overwrite").parquet(f"{root}/delta/{n}")
    _commit(spark, root, n)
    now_ = snapshot(spark, root, n)
    changed, gone = entries.where(F.col("origin") == n).count(), before.join(entries.select("path"), "path", "left_anti").count()
    passed = bool(smoke(now_.rows))
    if passed:
        # the hashes of all documents stand in the snapshot's entries, which the stamp names
        hashes = {f"entries/{n}": str(entries.count())}
        manifest(spark, embed_model, dim, now_.rows.count(), hashes).withColumn("snapshot", F.lit(n)).coalesce(1).write.mode("overwrite").parquet(f"{root}/stamp")
    return Built(n, changed, gone, passed)


def stamp(spark: SparkSession, root: str) -> DataFrame:
    """The stamp's row; none where no smoke test vouches for the index."""
    from ..schema import INDEX_MANIFEST

    schema = T.StructType([*INDEX_MANIFEST.fields, T.StructField("snapshot", T.IntegerType())])
    fs, p = _fs(spark, f"{root}/stamp/_SUCCESS")
    return spark.read.schema(schema).parquet(f"{root}/stamp") if fs.exists(p) else spark.createDataFrame([], schema)


def compact(spark: SparkSession, root: str) -> None:
    """One delta that holds what the last snapshot serves, as a snapshot of its own; older ones go."""
    old = snapshot(spark, root)
    if old is None:
        return
    n = old.n + 1
    old.rows.write.mode("overwrite").parquet(f"{root}/delta/{n}")
    old.entries.withColumn("origin", F.lit(n)).write.mode("overwrite").parquet(f"{root}/entries/{n}")
    _commit(spark, root, n)
    for v in versions(spark, root)[:-1]:
        for part in ("committed", "entries", "delta"):
            _delete(spark, f"{root}/{part}/{v}")
