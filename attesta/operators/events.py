"""Interval and as-of joins by merged events: one sort of both sides and a running value, linear however many rows a group has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import in_order, running


def _packed(df: DataFrame, by: list[str], kind: int, at: Column, payload: Column, row: Column) -> DataFrame:
    return df.select(*by, at.alias("__t"), F.lit(kind).alias("__kind"), payload.alias("__x"), row.alias("__row"))


def covered(points: DataFrame, intervals: DataFrame, by: list[str], point: str, lo: str, hi: str, name: str = "inside") -> DataFrame:
    """``points`` with ``name``: whether the point lies in any interval [lo, hi) of its group.

    Starts and points are sorted together, starts first where they meet; a point is inside where the furthest end so far lies beyond it.
    Nulls lie nowhere and cover nothing; groups of null are equal.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    none = F.lit(None)
    starts = _packed(intervals, by, 0, F.col(lo), F.col(hi), none.cast(points.select(row).schema[0].dataType))
    asked = _packed(points, by, 1, F.col(point), none.cast(intervals.schema[hi].dataType), row)
    reach = running(in_order(starts.unionByName(asked).withColumn("__t", F.col("__t")), by, ["__t", "__kind"]), by, {"__reach": ("max", F.when(F.col("__t").isNotNull(), F.col("__x")))})
    return reach.where("__kind = 1").select("__row.*", F.coalesce(F.col("__reach") > F.col("__t"), F.lit(False)).alias(name))


def asof(points: DataFrame, events: DataFrame, by: list[str], point: str, at: str, values: list[str], forward: bool = False) -> DataFrame:
    """``points`` with ``values`` of the nearest event of their group at or before the point (``forward``: at or after); null where there is none.

    Of events at one place the one of the smallest values counts.  Nulls are no places.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    side = F.struct(F.col(at).alias("t"), F.struct(*values).alias("v"))
    first = events.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.min(F.struct(*values)).alias("__v")).select(*by, at, "__v.*")
    told = _packed(first, by, 1 if forward else 0, F.col(at), side, F.lit(None).cast(points.select(row).schema[0].dataType))
    asked = _packed(points, by, 0 if forward else 1, F.col(point), F.lit(None).cast(first.select(side).schema[0].dataType), row)
    near = running(in_order(told.unionByName(asked), by, ["__t", "__kind"]), by, {"__near": ("min" if forward else "max", F.col("__x"))}, reverse=forward)
    hit = F.when(F.col("__t").isNotNull(), F.col("__near.v"))
    return near.where(F.col("__kind") == (0 if forward else 1)).select("__row.*", *[hit[v].alias(v) for v in values])
