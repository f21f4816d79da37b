"""Benchmark decontamination with suffix arrays over training shards.

A task cuts its documents into shards of a few MB and sorts each shard's word suffixes.  Every suffix of every
benchmark item is then narrowed down by binary search, one more word a step, until nothing matches: that gives its longest
verbatim match and where it stands.  Where the match reaches the window's length, the interval of the suffix array
lists all occurrences.

A suffix array keeps only suffixes whose first two words occur side by side in the benchmark (or whose first word is a one-word
item): no other can hold a window, and none could change a match of two words or more.  Suffixes
are told apart as deep as the longest item.  Words are compared by 64-bit hashes (see :mod:`.bytewise`).

The benchmark goes out in blocks of about ``block_bytes`` of text, the bound of the broadcast, and a longer item is cut
into overlapping parts; the common case is one block, and then no row is shuffled.  Further blocks are further passes whose hits are joined by document.

Edge cases: null and empty texts have no words and are clean; items without words never match; a null item_id prints as
"null"; null doc_ids pass through; repeated rows are judged alike; empty tables give empty or clean results; input
columns that clash with the result's give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewise import ALNUM, batches_of_texts, mix, words
from .common import let, row_key, utf8

SHARD_BYTES = 4 << 20


@dataclass
class Tests:
    """A block of items: their words with a 0 after each item, and the windows looked for."""

    ids: list[str]
    seq: np.ndarray
    start: np.ndarray  # of each test suffix in seq
    item: np.ndarray  # of each test suffix
    window: np.ndarray  # length of the window that begins there, 0 for none
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    singles: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    depth: int = 0


def tests_of(ids: list[str], texts: list[str | None], window: int) -> Tests:
    import pyarrow as pa

    h, bounds = words(*utf8(pa.array(texts, pa.string())), ALNUM)
    n = np.diff(bounds)
    item = np.repeat(np.arange(len(ids)), n)
    seq = np.zeros(len(h) + len(ids) + 1, np.uint64)
    start = np.arange(len(h)) + item
    seq[start] = h
    left = n[item] - (np.arange(len(h)) - bounds[:-1][item])  # words from here to the item's end
    length = np.where(n[item] >= window, np.where(left >= window, window, 0), np.where(left == n[item], left, 0))
    two = left >= 2
    pairs = np.unique(mix(seq[start[two]]) + seq[start[two] + 1])
    return Tests(ids, seq, start, item, length, pairs, np.unique(h[length == 1]), int(n.max(initial=0)))


def kept_suffixes(seq: np.ndarray, tests: Tests) -> np.ndarray:
    """Places in a shard's words from which a test suffix may match."""
    pair = mix(seq[:-1]) + seq[1:]
    sieve = np.zeros(1 << 20, bool)
    sieve[(tests.pairs >> np.uint64(44)).astype(np.int64)] = True
    some = np.flatnonzero(sieve[(pair >> np.uint64(44)).astype(np.int64)])
    at = some[_in(pair[some], tests.pairs) & (seq[some] != 0)]
    if len(tests.singles):
        at = np.union1d(at, np.flatnonzero(_in(seq[:-1], tests.singles)))
    return at


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def suffix_array(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the words from there, ``depth`` of them at most; a text's end (0) sorts first."""
    at = at[np.argsort(seq[at], kind="stable")]
    first = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]]) if len(at) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], True)
    live = np.flatnonzero(~(first & last))
    for d in range(1, depth):
        if not len(live):
            break
        g, key = group[live], seq[at[live] + d]
        order = np.lexsort((key, g))
        at[live], key, g = at[live][order], key[order], g[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        alone = new & np.append(new[1:], True)
        live = live[~alone & (key != 0)]
    return at


def _bound(seq, sa, lo, hi, d, word, right: bool):
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        here = seq[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + d, len(seq) - 1)]  # a closed search may look past the end
        down = (here <= word) if right else (here < word)
        lo, hi = np.where(open_ & down, mid + 1, lo), np.where(open_ & ~down, mid, hi)


def search(seq: np.ndarray, sa: np.ndarray, tests: Tests):
    """(length, place, lo, hi) for each test suffix: its longest match and one place of it, and the interval in which its window occurs."""
    n = len(tests.start)
    length, place, wlo, whi = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, lo, hi, d = np.arange(n), np.zeros(n, np.int64), np.full(n, len(sa)), 0
    while len(live):
        word = tests.seq[tests.start[live] + d]
        a = _bound(seq, sa, lo, hi, d, word, False)
        b = _bound(seq, sa, a, hi, d, word, True)
        ok = (word != 0) & (a < b)
        live, lo, hi, d = live[ok], a[ok], b[ok], d + 1
        length[live], place[live] = d, sa[lo] if len(live) else 0
        full = tests.window[live] == d
        wlo[live[full]], whi[live[full]] = lo[full], hi[full]
    return length, place, wlo, whi


def in_shard(h: np.ndarray, bounds: np.ndarray, tests: Tests):
    """For a shard's words: (spans by text, items by text, search results with places as (text, word))."""
    n = np.diff(bounds)
    texts = len(n)
    doc = np.repeat(np.arange(texts), n)
    seq = np.zeros(len(h) + texts + 1, np.uint64)
    seq[np.arange(len(h)) + doc] = h
    origin = bounds[:-1] + np.arange(texts)  # of each text in seq
    at = kept_suffixes(seq, tests) if len(h) and len(tests.start) else np.zeros(0, np.int64)
    spans: list[list[dict]] = [[] for _ in range(texts)]
    items: list[set[int]] = [set() for _ in range(texts)]
    if not len(at):
        return spans, items, None
    sa = suffix_array(seq, at, tests.depth)
    length, place, lo, hi = search(seq, sa, tests)
    edge = np.zeros(len(seq) + 1, np.int32)
    seen: set[tuple[int, int]] = set()
    for j in np.flatnonzero(hi > lo).tolist():
        a, b, w, it = int(lo[j]), int(hi[j]), int(tests.window[j]), int(tests.item[j])
        p = sa[a:b]
        if (a, w) not in seen:  # the same window elsewhere in the benchmark covers the same words
            seen.add((a, w))
            np.add.at(edge, p, 1)
            np.add.at(edge, p + w, -1)
        for t in np.unique(np.searchsorted(origin, p, "right") - 1).tolist():
            items[t].add(it)
    hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])
    turn = np.diff(hit)
    for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
        t = int(np.searchsorted(origin, s, "right")) - 1
        spans[t].append({"start": int(s - origin[t]), "end": int(e - origin[t])})
    t = np.searchsorted(origin, place, "right") - 1
    return spans, items, (length, t, place - origin[np.maximum(t, 0)])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [("n_words", T.LongType()), ("spans", SPAN), ("items", T.ArrayType(T.StringType()))]


def cut(text: str, window: int, most: int) -> Iterator[str]:
    """A text in parts of about ``most`` bytes that overlap by ``window`` - 1 words, so that each window is whole in one of them."""
    if len(text.encode()) <= most:
        yield text
        return
    ends, starts, size, lo = [], [], 0, 0
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
        starts.append(m.start())
        ends.append(m.end())
        size += len(m[0].encode()) + 1
        if size >= most and len(ends) - lo >= 2 * window:
            yield text[starts[lo] : ends[-1]]
            lo, size = len(ends) - (window - 1), 0
    if len(ends) - lo > window - 1 or lo == 0:
        yield text[starts[lo] if starts else 0 :]


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of about ``block_bytes`` of text each; a longer item is cut, and its parts go by its id.

    The items are a stated set of queries: the driver reads them one by one and holds one block at a time.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").where(F.col("text").isNotNull())
    spark, out, ids, texts, size = benchmark.sparkSession, [], [], [], 0
    for r in rows.toLocalIterator():
        for text in cut(r.text, window, block_bytes):
            n = len(text.encode())
            if ids and size + n > block_bytes:
                out.append(spark.sparkContext.broadcast(tests_of(ids, texts, window)))
                ids, texts, size = [], [], 0
            ids.append(r.i)
            texts.append(text)
            size += n
    out.append(spark.sparkContext.broadcast(tests_of(ids, texts, window)))
    return out


def _pass(docs: DataFrame, block, keep: list[str]) -> DataFrame:
    """``docs[keep]`` with what one block finds; needs the column ``text``."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in FOUND])

    def work(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            tests = block.value
            data, starts = utf8(batch.column("text"))
            for lo, hi in batches_of_texts(starts, SHARD_BYTES):
                part = starts[lo : hi + 1]
                h, bounds = words(data[part[0] : part[-1]], part - part[0], ALNUM)
                spans, items, _ = in_shard(h, bounds, tests)
                cols = [batch.column(c).slice(lo, hi - lo) for c in keep]
                cols += [pa.array(np.diff(bounds)), pa.array(spans, span), pa.array([sorted({tests.ids[i] for i in x}) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(work, schema)


def covered(spans) -> F.Column:
    """The length of the union of an array of spans."""
    step = F.aggregate(
        F.sort_array(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")),
    )
    return step["n"]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, spans (hit words, start to end), items, n_hit, n_items, contaminated."""
    own = {n for n, _ in FOUND} | {"n_hit", "n_items", "contaminated"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    blocks = _blocks(benchmark, window, block_bytes)
    if len(blocks) == 1:
        found = _pass(docs, blocks[0], keep)
    else:
        keyed = docs.withColumn("__key", row_key())
        every = [_pass(keyed, b, ["__key"]).where(F.size("items") > 0).distinct() for b in blocks]
        hits = every[0]
        for more in every[1:]:
            hits = hits.unionAll(more)
        hits = hits.groupBy("__key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        empty = docs.sparkSession.sparkContext.broadcast(tests_of([], [], window))
        all_rows = _pass(keyed, empty, [*keep, "__key"]).drop("spans", "items")
        found = all_rows.join(hits, "__key", "left").select(
            *keep, "n_words", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )
    return found.withColumns({"n_hit": let(F.col("spans"), covered), "n_items": F.size("items").cast("long")}).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    return mark(docs, benchmark, window).where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n for n, _ in FOUND} | {"n_hit", "n_items", "contaminated"}])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """For each item suffix that matches two words or more: item_id, item_word, length, and one place, doc_id and doc_word."""
    out = None
    for block in _blocks(benchmark, window, block_bytes):

        def work(batches, block=block):
            import pyarrow as pa

            for batch in batches:
                tests = block.value
                first = np.concatenate([[0], np.flatnonzero(np.diff(tests.item)) + 1]) if len(tests.item) else np.zeros(0, np.int64)
                data, starts = utf8(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                for lo, hi in batches_of_texts(starts, SHARD_BYTES):
                    part = starts[lo : hi + 1]
                    h, bounds = words(data[part[0] : part[-1]], part - part[0], ALNUM)
                    *_, got = in_shard(h, bounds, tests)
                    if got is None:
                        continue
                    length, doc, word = got
                    j = np.flatnonzero(length >= 2)
                    begin = first[np.searchsorted(first, j, "right") - 1]
                    yield pa.RecordBatch.from_pydict(
                        {"item_id": pa.array([tests.ids[i] for i in tests.item[j].tolist()], pa.string()), "item_word": pa.array(j - begin), "length": pa.array(length[j]), "doc_id": pa.array([ids[lo + d] for d in doc[j].tolist()], pa.int64()), "doc_word": pa.array(word[j])}
                    )

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "item_id string, item_word long, length long, doc_id long, doc_word long")
        out = found if out is None else out.unionAll(found)
    best = out.groupBy("item_id", "item_word").agg(F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("doc_word")).alias("w"))).alias("m"))
    return best.select("item_id", "item_word", F.col("m.length").alias("length"), (-F.col("m.d")).alias("doc_id"), (-F.col("m.w")).alias("doc_word"))
