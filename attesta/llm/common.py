"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, owned, scratch, shared_dir, written

__all__ = ["WS", "connected_components", "discard", "free_name", "let", "owned", "replaced", "row_key", "scratch", "shared_dir", "utf8", "written"]

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body).getItem(0)


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``; a column of the input with such a name gives way."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {k.lower() for k in columns}], *[v.alias(k) for k, v in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """A column name beginning with two underscores and ``name`` that ``df`` doesn't have in any case of letters."""
    taken, own = {c.lower() for c in df.columns}, f"__{name}"
    while own.lower() in taken:
        own += "_"
    return own


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Identifies a document row by id and text, so that null and repeated ids do no harm: equal rows get equal keys, and every operator here gives equal rows equal results."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.struct(F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.isNull().alias("n"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component) for each node of an edge list of longs; the component is its smallest node.

    Alternates hooking each node to the smallest label around it and jumping to the label's label, and writes
    each round to the shared folder.  The number of rounds grows with the logarithm of the longest path.
    Nothing but one count a round reaches the driver.  Hot labels are summed before the shuffle.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    both = written(edges.unionAll(edges.select("b", "a")).distinct().toDF("a", "b"), "edges")
    start = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    labels = start
    for _ in range(rounds):
        near = both.join(labels.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("l"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        # a label's own new label, offered by its members: the root that was hooked moves all of them
        moved = hooked.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("m"))
        # written, so that the join splits a large component's label
        step = written(hooked.join(moved, "node", "left").select("node", "old", F.least("label", "m").alias("label")), "hooked")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(step.join(jump, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels")
        discard(step)
        changed = new.where("old <> label").limit(1).count()
        discard(start)
        start, labels = new, new.select("node", "label")
        if not changed:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def utf8(column) -> tuple:
    """(bytes, starts) of an Arrow string array as numpy arrays; text i is bytes[starts[i]:starts[i + 1]] and a null is empty."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]
