"""Removal of repeated byte strings with suffix arrays.

Each ``length``-byte string (a window) of a text is owned by one anchor: the leftmost of its ``gram``-byte strings of the
smallest hash.  Equal windows have equal anchors at equal places, so windows are dealt to shards by their anchor's hash, and
no match crosses shards.  Anchors whose hash occurs once hold no repeated window and go no further: the hashes are counted in a first pass,
those that repeat become the bits of a broadcast map of a bounded size, and a second pass over the texts sends what the map lets through (a
bit that another hash has set sends a segment too many, which changes no result).  With more than ``mapped`` repeated hashes a map
would let nearly all through; then anchors and texts are joined instead.  What an anchor
sends is a segment: the bytes of the windows it owns.  Equal segments travel once, with their number.

A task packs segments into shards of ``SHARD_BYTES`` at most, builds the suffix array of each by Larsson-Sadakane refinement
(groups of equal prefixes are split by the rank of the suffix a prefix further on; settled suffixes drop out), and the
common prefixes of neighbours by Kasai's method, stepping through all segments side by side.  A window is repeated where it shares
``length`` bytes with a neighbour or its segment came more than once.  When a group of one anchor is larger than a shard's rest, its
segments go to two shards, and the two are merged by binary search of one's windows among the other's suffixes.
A text that repeats itself, such as a line of dashes, has an anchor at each of its bytes or periods; its equal segments travel once too,
with all their places.
An anchor with more than ``crowd`` different segments would be too much for one task.  Its segments are cut into parts of up to
``PART`` windows by their distance to the anchor, and a part is dealt by the hash of the bytes that all windows at these distances
share, to shards again.  If more than ``crowd`` parts still meet, their windows are dealt by their own 128-bit hash and counted.

Edge cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; a repeated row (same id and text)
is a copy like any other, so both lose their windows; null doc_ids pass through; an empty table gives an empty table; other input
columns are not read.  Documents are known by a 64-bit hash of id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import _BYTE, batches_of_texts, mix
from .common import discard, owned, utf8, written

BATCH_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
PART = 16
#: Bits of the map of repeated anchors at most (64 MB), and how many of them it may hold.
MAP_BITS, MAPPED = 29, 1 << 27
#: An odd constant for the polynomial over bytes.
BASE = 0x9FB21C651E98DF25


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of each ``gram`` bytes (a power of two), by doubling."""
    h, m = _BYTE[data], 1
    while m < gram:
        h = h[:-m] * np.uint64(pow(BASE, m, 1 << 64)) + h[m:]
        m *= 2
    return mix(h)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the smallest of values[i:i + width], told apart by 40 bits."""
    n = len(values)
    key = (values & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64) if n < 1 << 24 else None
    if key is None:  # a text beyond 16 MB: in overlapping parts
        step = (1 << 24) - width - 1
        parts = [sliding_argmin(values[i : i + step + width - 1], width) + i for i in range(0, n - width + 1, step)]
        return np.concatenate(parts)
    pad = (-n) % width
    full = np.append(key, np.full(pad, np.uint64(2**64 - 1))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (best & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """(hash, text, first window, number of windows, distance from the first window) of each anchor of the texts in ``data``."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    if len(data) < length:
        return none
    h = gram_hashes(data, gram)
    at = sliding_argmin(h, length - gram + 1)  # by window start
    s = np.arange(len(at))
    text = np.searchsorted(starts, s, "right") - 1
    ok = np.flatnonzero(s + length <= starts[text + 1])
    if not len(ok):
        return none
    a, t = at[ok], text[ok]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    first = np.flatnonzero(new)
    return h[a[first]], t[first], ok[first] - starts[t[first]], np.diff(np.append(first, len(a))), a[first] - ok[first]


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``text`` sorted by what follows up to their segment's end (``ends``, by place), ``depth`` bytes at least."""
    n = len(text)
    bits = np.uint64(max(1, n.bit_length()))
    place = np.arange(n)
    h = 4
    key = np.zeros(n, np.uint64)
    for j in range(h):
        inside = place + j < ends
        key = key * np.uint64(257) + np.where(inside, text[np.minimum(place + j, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    packed = np.sort((key << bits) | place.astype(np.uint64))
    sa = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    top = packed >> bits
    new = np.concatenate([[True], top[1:] != top[:-1]])
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank[sa] = group + 1
    live = np.flatnonzero(~(new & np.append(new[1:], True)))
    while h < depth and len(live):
        here = sa[live]
        nxt = np.where(here + h < ends[here], rank[np.minimum(here + h, n - 1)], 0)
        index = np.arange(len(live), dtype=np.uint64)
        low = np.uint64(max(1, len(live).bit_length()))
        if 2 * int(bits) + 1 + int(low) <= 64:  # one number holds group, next rank and index
            packed = np.sort((((group[live].astype(np.uint64) << (bits + np.uint64(1))) | nxt.astype(np.uint64)) << low) | index)
            order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        else:
            order = np.lexsort((nxt, group[live]))
        g, nxt, here = group[live][order], nxt[order], here[order]
        sa[live] = here
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1])])
        g = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        group[live] = g
        rank[here] = g + 1
        live = live[~(new & np.append(new[1:], True)) & (here + h < ends[here])]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, starts: np.ndarray, sa: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """By place: how many bytes (``most`` at most) it shares with its predecessor in ``sa``; Kasai's steps, all segments side by side."""
    n = len(text)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    size = np.diff(np.append(starts, n))
    order = np.argsort(-size, kind="stable")
    first, size = starts[order], size[order]
    got = np.zeros(len(first), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -step, "left"))  # segments longer than step
        i = first[:m] + step
        j = before[i]
        run = np.maximum(got[:m] - 1, 0)
        room = np.minimum(np.minimum(ends[i] - i, np.where(j >= 0, ends[j] - j, 0)), most)
        run = np.minimum(run, room)
        act = np.flatnonzero(run < room)
        while len(act):
            same = text[i[act] + run[act]] == text[j[act] + run[act]]
            act = act[same]
            run[act] += 1
            act = act[run[act] < room[act]]
        got[:m] = run
        out[i] = run
    return out


def repeated_in_shard(segments: list[bytes], many: list[bool], length: int) -> tuple[list[np.ndarray], tuple]:
    """(by segment: which windows are repeated, the sorted windows for merging)."""
    size = np.array([len(s) for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])[:-1]
    text = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.repeat(starts + size, size)
    # settled to the longest segment's end: the common prefixes' steps hold on a fully sorted array alone
    sa = suffix_array(text, ends, int(size.max()))
    lcp = common_prefixes(text, starts, sa, ends, length)
    hit = lcp >= length
    twin = np.zeros(len(text), bool)
    twin[sa[:-1]] = hit[sa[1:]]
    hit |= twin
    out = [np.ones(n - length + 1, bool) if m else hit[s : s + n - length + 1].copy() for s, n, m in zip(starts.tolist(), size.tolist(), many)]
    return out, (text, sa[ends[sa] - sa >= length], starts)


def merge(mine: list[bytes], flags: list[np.ndarray], other: tuple, length: int) -> None:
    """Flags the windows of ``mine`` that occur in ``other`` (sorted windows of an earlier shard), by binary search."""
    text, sa, _ = other
    raw = text.tobytes()
    for s, f in zip(mine, flags):
        for w in np.flatnonzero(~f).tolist():
            want = s[w : w + length]
            lo, hi = 0, len(sa)
            while lo < hi:
                mid = (lo + hi) >> 1
                if raw[sa[mid] : sa[mid] + length] < want:
                    lo = mid + 1
                else:
                    hi = mid
            f[w] = lo < len(sa) and raw[sa[lo] : sa[lo] + length] == want


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _anchor_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(fp, c) of every anchor's hash, summed in its task first."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            data, starts = utf8(batch.column("text"))
            for lo, hi in batches_of_texts(starts, BATCH_BYTES):
                part = starts[lo : hi + 1]
                fp, c = np.unique(anchors(data[part[0] : part[-1]], part - part[0], length, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(c.astype(np.int64))], names=["fp", "c"])

    return docs.select("text").mapInArrow(work, "fp long, c long").groupBy("fp").agg(F.sum("c").alias("c"))


def _map_of(often: DataFrame, n: int):
    """(bits, broadcast map): a bit for each repeated hash, sixteen times as many bits as there are hashes or 2**MAP_BITS at most."""
    bits = min(MAP_BITS, max(18, (16 * n).bit_length()))
    value = F.pmod("fp", F.lit(1 << bits)) + 1
    rows = often.groupBy(F.bitmap_bucket_number(value).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in rows.toLocalIterator():
        out[(r.n - 1) * 4096 : r.n * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits, often.sparkSession.sparkContext.broadcast(out)


SEGMENT = "fp long, k long, first array<int>, off int, seg binary"


def _segment_batch(out: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*out)) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], names=["fp", "k", "first", "off", "seg"])


def _segments_by_map(docs: DataFrame, often: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """(fp, k, first, off, seg, rows) where the map says that the anchor may be repeated: a second pass over the texts, which stay where they are."""
    bits, sent = _map_of(often, n)

    def work(batches):
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            keys = batch.column("k").to_numpy()
            for lo, hi in batches_of_texts(starts, BATCH_BYTES):
                part = starts[lo : hi + 1]
                fp, t, first, size, off = anchors(data[part[0] : part[-1]], part - part[0], length, gram)
                low = fp & np.uint64((1 << bits) - 1)
                some = np.flatnonzero((sent.value[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)
                raw, own = data[part[0] : part[-1]].tobytes(), {}
                at = (part - part[0])[t[some]] + first[some]
                for f, x, a, p, m, o in zip(fp[some].view(np.int64).tolist(), t[some].tolist(), first[some].tolist(), at.tolist(), size[some].tolist(), off[some].tolist()):
                    own.setdefault((x, f, o, raw[p : p + m + length - 1]), []).append(a)
                yield _segment_batch([(f, int(keys[lo + x]), places, o, seg) for (x, f, o, seg), places in own.items()])

    rows = docs.select("k", "text").mapInArrow(work, SEGMENT)
    return rows.withColumns({"sh": F.xxhash64("seg"), "rows": F.lit(1).cast("long")})


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            data, starts = utf8(batch.column("text"))
            keys = batch.column("k").to_numpy()
            for lo, hi in batches_of_texts(starts, BATCH_BYTES):
                part = starts[lo : hi + 1]
                fp, t, first, n, off = anchors(data[part[0] : part[-1]], part - part[0], length, gram)
                yield pa.RecordBatch.from_pydict({"fp": pa.array(fp.view(np.int64)), "k": pa.array(keys[lo + t]), "first": pa.array(first.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "off": pa.array(off.astype(np.int32))})

    return docs.select("k", "text").mapInArrow(work, "fp long, k long, first int, n int, off int")


def _segments_by_join(docs: DataFrame, often: DataFrame, length: int, gram: int) -> DataFrame:
    """The same where there are too many repeated anchors for a map: anchors are joined to their hashes, and texts to their anchors."""
    rows = written(_anchor_rows(docs, length, gram), "anchors")
    found = rows.join(often, "fp").groupBy("k").agg(F.collect_set(F.struct("fp", "first", "n", "off")).alias("a"))
    # of repeated rows one is followed, with the number of them
    copies = docs.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))

    def work(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                out = []
                for k, text, a in zip(part.column("k").to_pylist(), part.column("text").to_pylist(), part.column("a").to_pylist()):
                    raw, own = text.encode(), {}
                    for x in a:
                        own.setdefault((x["fp"], x["off"], raw[x["first"] : x["first"] + x["n"] + length - 1]), []).append(x["first"])
                    out += [(fp, k, places, off, seg) for (fp, off, seg), places in own.items()]
                yield _segment_batch(out)

    segments = docs.select("k", "text").dropDuplicates(["k"]).join(found, "k").mapInArrow(work, SEGMENT)
    return segments.withColumn("sh", F.xxhash64("seg")).join(copies, "k")


WINDOWS = "array<struct<a:int,b:int>>"


def _by_shards(segments: DataFrame, length: int) -> DataFrame:
    """(fp, sh, w): runs of repeated windows of segments (fp, sh, seg, many), by suffix arrays."""

    def work(batches):
        import pyarrow as pa

        rows, size, before = [], 0, None

        def shard():
            nonlocal before
            flags, sorted_ = repeated_in_shard([r[2] for r in rows], [r[3] for r in rows], length)
            if before is not None:
                last, old_rows, old_flags, old_sorted = before
                mine = [i for i, r in enumerate(rows) if r[0] == last]
                if mine:  # an anchor's segments on both sides
                    merge([rows[i][2] for i in mine], [flags[i] for i in mine], old_sorted, length)
                    theirs = [i for i, r in enumerate(old_rows) if r[0] == last]
                    merge([old_rows[i][2] for i in theirs], [old_flags[i] for i in theirs], sorted_, length)
                yield table(old_rows, old_flags)
            before = (rows[-1][0], list(rows), flags, sorted_)

        def table(rows, flags):
            found = [(r[0], r[1], [{"a": a, "b": b} for a, b in runs(f)]) for r, f in zip(rows, flags) if f.any()]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["fp", "sh", "w"])

        for batch in batches:
            for row in range(0, batch.num_rows, 1024):
                part = batch.slice(row, 1024)
                for r in zip(*(part.column(c).to_pylist() for c in ("fp", "sh", "seg", "many"))):
                    if rows and size + len(r[2]) > SHARD_BYTES:
                        yield from shard()
                        rows, size = [], 0
                    rows.append(r)
                    size += len(r[2])
        if rows:
            yield from shard()
        if before is not None:
            yield table(before[1], before[2])

    dealt = segments.repartition("fp").sortWithinPartitions("fp", "sh")
    return dealt.select("fp", "sh", "seg", "many").mapInArrow(work, f"fp long, sh long, w {WINDOWS}")


def _by_windows(segments: DataFrame, length: int) -> DataFrame:
    """(fp, sh, w) like :func:`_by_shards`, for anchors of too many segments: each window is counted by its own hash."""
    at = F.explode(F.sequence(F.lit(0), F.length("seg") - length))
    rows = segments.select("fp", "sh", "times", "seg", at.alias("i"))
    window = F.substring(F.col("seg"), F.col("i") + 1, F.lit(length))
    rows = rows.select("fp", "sh", "i", "times", F.xxhash64(window).alias("x"), F.xxhash64(F.lit(1), window).alias("y"))
    often = rows.groupBy("fp", "x", "y").agg(F.sum("times").alias("times")).where("times >= 2").select("fp", "x", "y")
    hit = rows.join(often, ["fp", "x", "y"]).groupBy("fp", "sh").agg(F.collect_list(F.struct(F.col("i").alias("a"), F.col("i").alias("b"))).alias("w"))
    return hit.select("fp", "sh", F.col("w").cast(WINDOWS).alias("w"))


def _parts(segments: DataFrame, length: int) -> DataFrame:
    """(fp, sh, lo, part_fp, part_sh, seg, times): segments cut by their windows' distance to the anchor; lo is the part's first window."""
    n = F.length("seg") - (length - 1)
    bucket = F.sequence(F.floor((F.col("off") - n + 1) / PART), F.floor(F.col("off") / PART))
    rows = segments.select("fp", "sh", "times", "off", "seg", n.alias("n"), F.explode(bucket).alias("q")).withColumn("near", (F.col("off") - PART * F.col("q")).cast("int"))
    rows = rows.withColumns({"lo": F.greatest(F.lit(0), F.col("near") - (PART - 1)), "hi": F.least(F.col("n") - 1, F.col("near"))})
    shared = F.substring(F.col("seg"), F.col("near") + 1, F.lit(length - PART + 1))
    rows = rows.withColumns({"part_fp": F.xxhash64("fp", "q", shared), "part": F.substring(F.col("seg"), F.col("lo") + 1, F.col("hi") - F.col("lo") + length)})
    return rows.select("fp", "sh", "lo", "part_fp", F.xxhash64("part").alias("part_sh"), F.col("part").alias("seg"), "times")


def _decide(distinct: DataFrame, length: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(hits, crowded): runs of repeated windows (fp, sh, w), and the anchors of too many segments (fp, sh, seg, times) to tell."""
    # written, so that the joins split a hot anchor's rows
    others = written(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.max("times").alias("times")), "anchor-counts")
    # an anchor of one segment has no other to compare: if that came more than once, so did each of its windows
    alone = distinct.join(others.where("c = 1 and times > 1").select("fp"), "fp", "left_semi")
    hits = alone.select("fp", "sh", F.array(F.struct(F.lit(0).alias("a"), (F.length("seg") - length).alias("b"))).cast(WINDOWS).alias("w"))
    some = distinct.join(others.where(f"c > 1 and c <= {crowd} or c = 1 and times = 1").select("fp"), "fp", "left_semi")
    hits = hits.unionAll(_by_shards(some.withColumn("many", F.col("times") > 1), length))
    return hits, written(others.where(F.col("c") > crowd).select("fp"), "crowded")


def _spans(keyed: DataFrame, length: int, gram: int, crowd: int, mapped: int) -> DataFrame:
    """(k, w): the repeated windows' spans of each document that has some, sorted."""
    # written, so that the joins split a hot anchor's rows
    often = written(_anchor_counts(keyed, length, gram).where("c >= 2").select("fp"), "often")
    n = often.count()
    segments = written(_segments_by_map(keyed, often, n, length, gram) if n <= mapped else _segments_by_join(keyed, often, length, gram), "segments")
    discard(often)
    counted = segments.groupBy("fp", "sh").agg(F.first("seg").alias("seg"), F.first("off").alias("off"), F.sum(F.size("first") * F.col("rows")).alias("times"))
    distinct = written(counted, "distinct")
    hits, crowded = _decide(distinct, length, crowd)
    if crowded.limit(1).count():
        parts = written(_parts(distinct.join(crowded, "fp"), length), "parts")
        own = parts.groupBy(F.col("part_fp").alias("fp"), F.col("part_sh").alias("sh")).agg(F.first("seg").alias("seg"), F.sum("times").alias("times"))
        own = written(own, "distinct-parts")
        found, still = _decide(own, length, crowd)
        if still.limit(1).count():
            found = found.unionAll(_by_windows(own.join(still, "fp"), length))
        back = parts.select("fp", "sh", "lo", "part_fp", "part_sh").join(found.toDF("part_fp", "part_sh", "w"), ["part_fp", "part_sh"])
        hits = hits.unionAll(back.select("fp", "sh", F.transform("w", lambda x: F.struct((x["a"] + F.col("lo")).alias("a"), (x["b"] + F.col("lo")).alias("b"))).cast(WINDOWS).alias("w")))
    hits = written(hits, "hits")
    discard(distinct)
    # of repeated rows one has its spans gathered
    spans = segments.select("fp", "sh", "k", "first").dropDuplicates().join(hits, ["fp", "sh"])
    at = lambda first: F.transform("w", lambda x: F.struct((first + x["a"]).alias("a"), (first + x["b"] + length).alias("b")))
    spans = spans.select("k", F.flatten(F.transform("first", at)).alias("w"))
    return spans.groupBy("k").agg(F.sort_array(F.flatten(F.collect_list("w"))).alias("w"))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, crowd: int = 1024, mapped: int = MAPPED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each document."""
    keyed = _keyed(docs)
    with owned(docs.sparkSession):
        spans = written(_spans(keyed, length, gram, crowd, mapped), "spans", own=False)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, text, w in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("w").to_pylist()):
                raw, kept, to, n = text.encode(), [], 0, 0
                merged: list[list[int]] = []
                for x in w or ():
                    if merged and x["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["b"])
                    else:
                        merged.append([x["a"], x["b"]])
                for a, b in merged:
                    kept.append(raw[to:a])
                    to, n = b, n + b - a
                kept.append(raw[to:])
                out.append((doc, len(raw), n, len(merged), b"".join(kept)))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return keyed.join(spans, "k", "left").select("doc_id", "text", "w").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
