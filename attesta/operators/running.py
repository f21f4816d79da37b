"""Running sums, least and greatest values along an order, in groups of any size.

A window over a whole group sorts that group in one task.  Here rows are sorted by range instead, so a large group lies in several
stretches; each stretch runs on its own, and what a group has gathered in earlier stretches is added.  At most one
group reaches over the border of two stretches, so what is carried has two rows a stretch at most and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: ``place`` is a stretch's number times 2**33 and the row's number in it.
SHIFT = 33
KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def in_order(df: DataFrame, by: list[str], order: list[Column | str], name: str = "ordered", stretches: int | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df``, written, with ``place``: a long that grows along ``by`` and then ``order``.  Ties get some order, which then stays.

    then: what to make of the sorted rows, one by one and with ``by`` kept, before they are written; the range sort reads ``df`` twice, and this runs once.
    """
    keys = [*by, *order, F.rand(7)]  # equal rows may be many: they spread over stretches too
    dealt = df.repartitionByRange(stretches, *keys) if stretches else df.repartitionByRange(*keys)
    rows = dealt.sortWithinPartitions(*by, *order)
    return written((then(rows) if then else rows).withColumn("place", F.monotonically_increasing_id()), name)


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & a[c].eqNullSafe(b[f"__{c}"])
    return out


def running(rows: DataFrame, by: list[str], values: dict[str, tuple[str, Column]], reverse: bool = False) -> DataFrame:
    """``rows`` of :func:`in_order` with one more column for each of ``values``: name -> (sum, min or max, of what).

    A row's value covers its group up to and with the row itself (``reverse``: from the row on).  Null inputs are skipped; a
    value over nulls alone is null.
    """
    if not by:
        rows, by, whole = rows.withColumn("__whole", F.lit(0)), ["__whole"], True
    else:
        whole = False
    at = F.shiftright("place", SHIFT)
    rows = rows.withColumns({"__at": at, **{f"__v_{k}": c for k, (_, c) in values.items()}})
    order = lambda c: F.desc(c) if reverse else F.asc(c)
    inside = Window.partitionBy("__at", *by).orderBy(order("place")).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"__r_{k}": KINDS[kind](f"__v_{k}").over(inside) for k, (kind, _) in values.items()})
    # groups that may reach over a border: the last of each stretch
    last = rows.groupBy("__at").agg(F.max_by(F.struct(*by), "place").alias("x")).select(*[F.col(f"x.{c}").alias(f"__{c}") for c in by]).distinct()
    wide = rows.join(F.broadcast(last), _same(rows, last, by), "left_semi")
    totals = wide.groupBy(*by, "__at").agg(*[KINDS[kind](f"__v_{k}").alias(f"__v_{k}") for k, (kind, _) in values.items()])
    before = Window.partitionBy(*by).orderBy(order("__at")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__at").alias("__to"), *[KINDS[kind](f"__v_{k}").over(before).alias(f"__c_{k}") for k, (kind, _) in values.items()])
    both = own.join(F.broadcast(carried), (own["__at"] == carried["__to"]) & _same(own, carried, by), "left")
    out = {}
    for k, (kind, _) in values.items():
        a, b = F.col(f"__r_{k}"), F.col(f"__c_{k}")
        out[k] = F.coalesce(a + b, a, b) if kind == "sum" else (F.least if kind == "min" else F.greatest)(a, b) if not _is_struct(rows, f"__v_{k}") else _pick(kind, a, b)
    keep = [c for c in rows.columns if not c.startswith("__v_") and c not in ("__at", "__whole" if whole else "__at")]
    return both.select(*keep, *[v.alias(k) for k, v in out.items()])


def _is_struct(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "struct"


def _pick(kind: str, a: Column, b: Column) -> Column:
    """The lesser or greater of two structs, either of which may be null."""
    pair = F.filter(F.array(a, b), lambda x: x.isNotNull())
    return F.array_min(pair) if kind == "min" else F.array_max(pair)
