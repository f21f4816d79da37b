"""Tables written to the folder that driver and executors share, to cut lineage.

Writing runs a job when a query is built, not when it is read.  A step that has read a table for the last time drops it with
:func:`discard`; what a returned DataFrame still reads lives until the :func:`owned` block around it ends, or until :func:`clear`.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL = threading.local()
_ALL: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset, a local session (tests) makes one, and a cluster's raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str, own: bool = True) -> str:
    """A new path for a written table in the shared folder; with ``own=False`` it outlives the innermost :func:`owned` block."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _ALL.add(path)
    owners = getattr(_LOCAL, "owners", [])
    for owner in owners if own else owners[:-1]:
        owner.add(path)
    return path


def written(df: DataFrame, name: str, own: bool = True) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name, own)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _remove(spark: SparkSession, paths) -> None:
    context = spark.sparkContext
    for p in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _ALL.discard(p)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that :func:`written` gave and nothing will read again."""
    for t in tables:
        _remove(t.sparkSession, [t.scratch_path])


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Removes at its end every table written inside: for a caller that has stored the result by then."""
    mine: set[str] = set()
    stack = _LOCAL.__dict__.setdefault("owners", [])
    stack.append(mine)
    try:
        yield
    finally:
        stack.remove(mine)
        _remove(spark, mine)


def clear(spark: SparkSession) -> None:
    """Removes every table that this process has written and not yet removed."""
    _remove(spark, list(_ALL))
