"""Running values against a plain loop, with groups larger than a stretch."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators.running import in_order, running


@pytest.mark.parametrize("reverse", [False, True])
def test_running(spark, reverse):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None, str(r.randrange(20))]), r.randrange(50), i, None if r.random() < 0.1 else r.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t int, i int, v long")
    o = in_order(df, ["g"], ["t", "i"], stretches=9)
    assert o.select(F.shiftright("place", 33)).distinct().count() > 4
    got = running(o, ["g"], {"s": ("sum", F.col("v")), "n": ("sum", F.lit(1)), "lo": ("min", F.col("v")), "at": ("max", F.when(F.col("v") > 50, F.struct("t", "i")))}, reverse)
    got = {x.i: (x.s, x.n, x.lo, tuple(x["at"]) if x["at"] else None) for x in got.collect()}
    want = {}
    for _, group in itertools.groupby(sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1], x[2])), key=lambda x: x[0]):
        seen = []
        for x in list(group)[:: -1 if reverse else 1]:
            seen.append(x)
            vs = [y[3] for y in seen if y[3] is not None]
            want[x[2]] = (sum(vs) if vs else None, len(seen), min(vs, default=None), max(((y[1], y[2]) for y in seen if (y[3] or 0) > 50), default=None))
    assert got == want


def test_whole_table_and_empty(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    got = {x.id: x.s for x in running(in_order(df, [], ["id"], stretches=5), [], {"s": ("sum", F.col("v"))}).collect()}
    assert got == dict(zip(range(100), itertools.accumulate(i % 7 for i in range(100))))
    assert running(in_order(df.where("id < 0"), [], ["id"]), [], {"s": ("sum", F.col("v"))}).count() == 0
