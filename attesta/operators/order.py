"""Is a text's order kept?  Two conversions of a document, word by word, both ways.

Either side is blocks in order; its words make one stream a document, and every ``n`` words in a row a shingle.  The r-th occurrence of a
shingle on one side meets the r-th on the other, so matching is linear however often a phrase repeats.  Matches that go on side by side
are one run, found by joins on the neighbouring places; the increasing runs that hold most shingles are the order that both
sides share.  What is left of the first side's words is told by class:

SPLICE   stands on the other side, but elsewhere than the shared order has it;
REPEAT   stands there too, but not as often as here;
ABSENT   stands nowhere there, and is whole blocks;
DROPOUT  stands nowhere there, and is part of a block or ends inside one.

Blocks are numbered and placed by sums carried over sorted stretches, so one document may hold any share of the rows.  Shingles of documents up to
``LONG`` words are matched in one shuffle, by document and shingle, and longer documents by such sums, with the same rows.  Only a document's
runs come together in a task: as many as there are breaks in its order, not as there are words.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import written
from .running import in_order, running

SHINGLE = 4
#: Words of both sides up to which a document's occurrences of one shingle, and its matches on one diagonal, may meet in a task.
LONG = 1 << 20


def _meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of one name on both sides, in which null keys are equal; the columns of ``a`` stay, then those that ``b`` adds."""
    right = b.withColumnsRenamed({c: f"__{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(right, cond, how).drop(*[f"__{c}" for c in on])


def _stream(rows: DataFrame, key: str, pos: str, text: str, n: int, words) -> tuple[DataFrame, DataFrame]:
    """(blocks, shingles): blocks (key, block, start, words) with the place of their first word; shingles (key, h, place)."""
    whole = rows.select(F.col(key).alias("key"), F.col(pos).alias("block"), F.col(text).alias("text"))
    size = F.size("w").cast("long")
    split = in_order(whole, ["key"], ["block"], then=lambda df: df.select("key", "block", words(F.col("text")).alias("w")).where(F.size("w") > 0))
    blocks = running(split, ["key"], {"end": ("sum", size), "no": ("sum", F.lit(1).cast("long"))})
    blocks = written(blocks.select("key", "block", "no", (F.col("end") - size).alias("start"), "w"), "blocks")
    # the next words after a block, from the heads of up to n - 1 blocks behind it
    heads = blocks.select("key", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("d"), "no", F.slice("w", 1, n - 1).alias("head")).withColumn("no", F.col("no") - F.col("d"))
    after = heads.where("no > 0").groupBy("key", "no").agg(F.sort_array(F.collect_list(F.struct("d", "head"))).alias("x")).select("key", "no", F.slice(F.flatten("x.head"), 1, n - 1).alias("after"))
    both = _meet(blocks, after, ["key", "no"], "left").select("key", "no", "start", "w", F.concat("w", F.coalesce("after", F.array().cast("array<string>"))).alias("all"))
    many = F.size("all") - (n - 1)
    at = F.when(many > 0, F.sequence(F.lit(0), F.least(F.size("w"), many) - 1)).when((F.col("no") == 1) & (F.size("all") < n), F.array(F.lit(0)))
    gram = F.transform(at, lambda i: F.struct(i.alias("i"), F.xxhash64(*[F.get("all", i + k) for k in range(n)]).alias("h")))
    shingles = both.select("key", "start", F.explode(gram).alias("g")).select("key", "g.h", (F.col("start") + F.col("g.i")).alias("place"))
    return blocks.select("key", "block", "start", size.alias("words")), shingles


def _ranked(shingles: DataFrame, name: str) -> DataFrame:
    """(key, h, r, name): which occurrence of a shingle this is."""
    o = in_order(shingles.withColumnRenamed("place", name), ["key", "h"], [name])
    return running(o, ["key", "h"], {"r": ("sum", F.lit(1).cast("long"))}).drop("place")


def increasing(runs: list[tuple[int, int, int]]) -> list[bool]:
    """Which runs (i, j, size), in the order of i, make the increasing sequence of j of the greatest total size.

    Of several, the one whose first differing run comes first.  From the last run to the first, a frontier holds for each reachable
    size the greatest j from which it can be reached, so that a run's best continuation is found by bisection.
    """
    frontier: list[tuple[int, int]] = []  # (-j, total) with both growing: further left needs more room, and reaches more
    total = [0] * len(runs)
    for k in range(len(runs) - 1, -1, -1):
        _, j, size = runs[k]
        at = bisect_left(frontier, (-j, -1))
        total[k] = size + (frontier[at - 1][1] if at else 0)
        if at < len(frontier) and frontier[at][0] == -j and frontier[at][1] >= total[k]:
            continue
        insort(frontier, (-j, total[k]))
        at = bisect_left(frontier, (-j, total[k])) + 1
        while at < len(frontier) and frontier[at][1] <= total[k]:
            del frontier[at]
    out, need, last = [], max(total, default=0), -1
    for (_, j, size), t in zip(runs, total):
        take = t == need and j > last and need > 0
        out.append(take)
        if take:
            need, last = need - size, j
    return out


def _gaps(kept: list[tuple[int, int]], moved: list[tuple[int, int, int]], repeated: list[tuple[int, int]], end: int) -> list[tuple[str, int, int, int | None]]:
    """(class, start, words, to) of the places before ``end`` that no interval of ``kept`` covers; the classes take their turn where they overlap."""
    marks = sorted([(a, 0, b, None) for a, b in kept] + [(a, 1, b, j) for a, b, j in moved] + [(a, 2, b, None) for a, b in repeated])
    edges = sorted({0, end, *(x for m in marks for x in (m[0], m[2]))})
    out: list[list] = []
    live: list[tuple[int, int, int, int | None]] = []
    k = 0
    for a, b in zip(edges, edges[1:]):
        while k < len(marks) and marks[k][0] <= a:
            live.append((marks[k][1], marks[k][0], marks[k][2], marks[k][3]))
            k += 1
        live = [m for m in live if m[2] > a]
        top = min(live, default=(3, 0, 0, None))
        name, to = ("", "SPLICE", "REPEAT", "LOST")[top[0]], None if top[3] is None else top[3] + a - top[1]
        if not name:
            continue
        if out and out[-1][0] == name and out[-1][1] + out[-1][2] == a and (to is None or out[-1][3] + out[-1][2] == to):
            out[-1][2] += b - a
        else:
            out.append([name, a, b - a, to])
    return [tuple(x) for x in out]


def _matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, i, j, there): a row for each shingle of either side; there: an unmatched one stands on the other side all the same."""
    both = a.select("key", "h", F.lit(0).alias("side"), "place").unionByName(b.select("key", "h", F.lit(1).alias("side"), "place")).repartition("key", "h")
    group = Window.partitionBy("key", "h").orderBy("side", "place")
    before = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max("side").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = both.withColumns({"n": F.count(F.lit(1)).over(before), "first": F.sum(1 - F.col("side")).over(before), "last": last})
    own = lambda side: F.max(F.when(F.col("side") == side, F.col("place")))
    rows = rows.withColumn("r", F.when(F.col("side") == 0, F.col("n")).otherwise(F.col("n") - F.col("first")))
    there = F.max(F.when(F.col("side") == 0, F.col("last") == 1).otherwise(F.col("first") > 0))
    return rows.groupBy("key", "h", "r").agg(own(0).alias("i"), own(1).alias("j"), there.alias("there")).select("key", "i", "j", "there")


def _matched_long(a: DataFrame, b: DataFrame) -> DataFrame:
    """:func:`_matched` of documents of any length."""
    i, j = (written(_ranked(x, name), "ranked") for x, name in ((a, "i"), (b, "j")))

    def alone(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        rest = _meet(own, other.select("key", "h", "r"), ["key", "h", "r"], "left_anti")
        return _meet(rest, other.select("key", "h").distinct().withColumn("there", F.lit(True)), ["key", "h"], "left").select("key", name, F.coalesce("there", F.lit(False)).alias("there"))

    none = F.lit(None).cast("long")
    met = _meet(i, j, ["key", "h", "r"]).select("key", "i", "j", F.lit(True).alias("there"))
    met = met.unionByName(alone(i, j, "i").withColumn("j", none)).unionByName(alone(j, i, "j").withColumn("i", none))
    return met.select("key", "i", "j", "there")


def _runs(hit: DataFrame) -> DataFrame:
    """(key, i, j, size): matches (key, i, j) that go on side by side."""
    way = Window.partitionBy("key", "d").orderBy("i")
    rows = hit.withColumn("d", F.col("j") - F.col("i")).withColumn("new", F.coalesce(F.col("i") - F.lag("i").over(way) != 1, F.lit(True)).cast("long"))
    rows = rows.withColumn("k", F.sum("new").over(way.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("key", "d", "k").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("size")).select("key", "i", (F.col("i") + F.col("d")).alias("j"), "size")


def _runs_long(hit: DataFrame) -> DataFrame:
    """:func:`_runs` of documents of any length."""

    def edges(step: int, name: str) -> DataFrame:
        """Matches whose neighbour a step away is none, numbered along their diagonal."""
        beside = hit.select("key", (F.col("i") - step).alias("i"), (F.col("j") - step).alias("j"))
        ends = _meet(hit, beside, ["key", "i", "j"], "left_anti").withColumn("d", F.col("j") - F.col("i"))
        o = in_order(ends, ["key", "d"], ["i"], name)
        return running(o, ["key", "d"], {"k": ("sum", F.lit(1).cast("long"))}).drop("place")

    first, last = edges(-1, "starts"), edges(1, "ends").select("key", "d", "k", F.col("i").alias("to"))
    return _meet(first, last, ["key", "d", "k"]).select("key", "i", "j", (F.col("to") - F.col("i") + 1).alias("size"))


def _one_way(blocks: DataFrame, met: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """One direction: met (key, i, j, there), runs (key, i, j, size), with i on the side of ``blocks``."""
    runs = runs.select("key", F.lit(0).alias("kind"), "i", "j", "size")
    # unmatched shingles that the other side has all the same
    short = met.where("i is not null and j is null and there").select("key", F.lit(1).alias("kind"), "i")
    # a stretch of these is one row for every 4096 places at least
    short = short.groupBy("key", "kind", F.floor(F.col("i") / 4096).alias("b")).agg(F.sort_array(F.collect_list("i")).alias("s"))
    short = short.select("key", "kind", F.explode(_stretches(F.col("s"))).alias("x")).select("key", "kind", "x.i", F.lit(None).cast("long").alias("j"), "x.size")
    ends = blocks.groupBy("key").agg(F.max(F.col("start") + F.col("words")).alias("size")).select("key", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), "size")
    parts = runs.unionByName(short).unionByName(ends)
    kind = blocks.schema["key"].dataType

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        def told(key, rows):
            own = [(i, j, s) for k, i, j, s in rows if k == 0]
            end = next(s for k, _, _, s in rows if k == 2)
            flags = increasing(own)
            wide = lambda i, s: (i, min(end, i + s + n - 1))
            kept = [wide(i, s) for (i, _, s), f in zip(own, flags) if f]
            moved = [(*wide(i, s), j) for (i, j, s), f in zip(own, flags) if not f]
            return [(key, *x) for x in _gaps(kept, moved, [wide(i, s) for k, i, _, s in rows if k == 1], end)]

        def table(out):
            cols = list(zip(*out)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(kind)), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["key", "class", "start", "words", "to"])

        key, rows, begun, out = None, [], False, []
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "i", "j", "size"))):
                if begun and k != key:
                    out += told(key, rows)
                    rows = []
                key, begun = k, True
                rows.append(row)
                if len(out) >= 10_000:
                    yield table(out)
                    out = []
        if begun:
            out += told(key, rows)
        yield table(out)

    found = parts.repartition("key").sortWithinPartitions("key", "kind", "i").select("key", "kind", "i", "j", "size").mapInArrow(work, f"key {kind.simpleString()}, class string, start long, words long, to long")
    found = written(found, "found")
    starts, stops = blocks.select("key", "start", F.col("block").alias("at_start")), blocks.select("key", (F.col("start") + F.col("words")).alias("stop"), F.lit(True).alias("at_end"))
    out = _meet(found, starts, ["key", "start"], "left").withColumn("stop", F.col("start") + F.col("words"))
    out = _meet(out, stops, ["key", "stop"], "left")
    named = F.when(F.col("class") != "LOST", F.col("class")).when(F.col("at_start").isNotNull() & F.col("at_end"), "ABSENT").otherwise("DROPOUT")
    return out.select("key", named.alias("class"), "start", "words", "to")


def _stretches(s: Column) -> Column:
    """Sorted places as an array of (i, size): how far each goes on without a gap."""
    start = F.array().cast("array<struct<i:bigint,size:bigint>>")

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        goes = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["i"] + F.try_element_at(out, F.lit(-1))["size"] == x)
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["i"].alias("i"), (last["size"] + 1).alias("size"))))
        return F.when(goes, longer).otherwise(F.concat(out, F.array(F.struct(x.alias("i"), F.lit(1).cast("long").alias("size")))))

    return F.aggregate(s, start, step)


def order_runs(source: DataFrame, corpus: DataFrame, key: str, pos: str, text: str, n: int = SHINGLE, words=tokens, long: int = LONG) -> DataFrame:
    """(key, direction, class, start, words, to): runs of words out of the shared order, source -> corpus and corpus -> source.

    start: the run's first word in its own stream, from 0; to: where a SPLICE stands on the other side.  A document of one side alone is
    ABSENT as a whole; blocks without a word, null texts among them, are no blocks; a null key is a document like any other; an
    empty side is one without blocks.  Blocks of a document are ordered by ``pos``.
    """
    (a, grams_a), (b, grams_b) = (_stream(df, key, pos, text, n, words) for df in (source, corpus))
    sizes = a.select("key", "words").unionByName(b.select("key", "words")).groupBy("key").agg(F.sum("words").alias("words"))
    # a row for each ``long`` words at most
    large = written(sizes.where(F.col("words") > long).select("key"), "long")
    if not large.head(1):
        met = written(_matched(grams_a, grams_b), "met")
        runs = _runs(met.where("i is not null and j is not null").select("key", "i", "j"))
    else:
        of = lambda df, how: _meet(df, F.broadcast(large), ["key"], how)
        met = written(_matched(of(grams_a, "left_anti"), of(grams_b, "left_anti")).unionByName(_matched_long(of(grams_a, "left_semi"), of(grams_b, "left_semi"))), "met")
        hit = met.where("i is not null and j is not null").select("key", "i", "j")
        runs = _runs(of(hit, "left_anti")).unionByName(_runs_long(of(hit, "left_semi")))
    runs = written(runs, "runs")
    swap = lambda df: df.select(*[F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in df.columns])
    there, back = _one_way(a, met, runs, n), _one_way(b, swap(met), swap(runs), n)
    both = there.withColumn("direction", F.lit("source -> corpus")).unionByName(back.withColumn("direction", F.lit("corpus -> source")))
    return both.select(F.col("key").alias(key), "direction", "class", "start", "words", "to")
