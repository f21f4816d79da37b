"""Packing along a space-filling curve.

A document's vector holds the counts of its hashed byte trigrams by their number, so that a text and its repetition have one
vector; a fixed random projection takes the vector to three numbers.  Each number becomes a cell by its place among
all documents' numbers (quantiles over the whole table), and the cells' Hilbert key orders the documents so that like ones are neighbours.
Bytes are counted along the curve, in 2**16 stretches, and the curve is cut into tasks of about equal bytes; a stretch that
holds more than one task's share, such as a large group of copies, goes to several tasks by a hash of the documents' ids.  Each
task sorts its documents by key, concatenates their ids and cuts every ``length`` ids.  The rest of a task is cut into runs
whose lengths are powers of two, so nothing is padded at all.

A task streams its rows: it holds one Arrow batch and one open sequence.

Edge cases: a null or empty text is the end id alone; null doc_ids are kept and count as the smallest id; repeated
rows are packed each; an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import mix
from .common import discard, row_key, utf8, written
from .tokens import encoder, tokenizer_path

#: Bits of a cell's number in each of the three dimensions; cells that have edges; bits of the key that name a stretch of the curve.
BITS, CELLS, STRETCH = 16, 256, 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each row of ``cells`` (whole numbers under 2**bits), for dims * bits < 64.

    Goes from the highest bit down: each level's corner is named in Gray code, and the axes below are swapped or
    mirrored so that the next level's curve joins on.
    """
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        low = bit - one
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key


def projections(texts, seed: int = 7) -> np.ndarray:
    """Three numbers for each text of an Arrow string array: the mean over its hashed trigrams of three random signs.

    The three sums run in one integer, 21 bits each, so a block holds fewer than 2**21 trigrams.
    """
    data, starts = utf8(texts)
    lanes = np.random.default_rng(seed).integers(0, 2, (1 << 16, 3)).astype(np.int64) @ np.array([1, 1 << 21, 1 << 42])
    sums, count = np.zeros((len(starts) - 1, 3)), np.zeros(len(starts) - 1)
    block = 1 << 20
    for lo in range(0, len(data) - 2, block):  # bounded memory, whatever the batch
        part = data[lo : lo + block + 2].astype(np.uint16)
        code = part[:-2] * np.uint16(31 * 257) + part[1:-1] * np.uint16(257) + part[2:]
        first = int(np.searchsorted(starts, lo, "right")) - 1
        last = int(np.searchsorted(starts, lo + len(code) - 1, "right")) - 1
        cuts = np.maximum(starts[first : last + 1] - lo, 0)
        some = np.flatnonzero(np.diff(np.append(cuts, len(code))))  # texts with bytes here
        got = np.add.reduceat(lanes[code], cuts[some])
        sums[first + some] += np.stack([(got >> (21 * d)) & ((1 << 21) - 1) for d in range(3)], axis=1)
        count[first + some] += np.diff(np.append(cuts, len(code)))[some]
    return (2 * sums - count[:, None]) / np.maximum(count[:, None], 1)


def curve_keys(points: np.ndarray, edges: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each point; edges: by dimension the sorted quantiles that part its cells."""
    step = (1 << bits) / (edges.shape[1] + 1)
    cells = np.stack([np.searchsorted(e, p, "right") for e, p in zip(edges, points.T)], axis=1)
    return hilbert_keys((cells * step).astype(np.int64), bits).astype(np.int64)


def shares(sizes: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """(first task, number of tasks) of each stretch of the curve, so that each of ``tasks`` tasks gets about the same size."""
    ends = np.cumsum(sizes)
    total = max(int(ends[-1]), 1)
    first = np.minimum((ends - sizes) * tasks // total, tasks - 1)
    last = np.minimum(np.maximum(ends - 1, ends - sizes) * tasks // total, tasks - 1)
    wide = sizes * tasks > total  # more than one task's share; any other stretch goes to one task
    return first, np.where(wide, last - first + 1, 1)


def _layout(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(edges, first, number, tasks): the cells' edges, and what :func:`shares` gives, from all documents.

    What reaches the driver are 3 * (CELLS - 1) quantiles and at most 2**STRETCH counts.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            p = projections(batch.column("text"))
            size = np.diff(utf8(batch.column("text"))[1]) + 64  # a row costs as much as some bytes
            yield pa.RecordBatch.from_arrays([*(pa.array(p[:, d]) for d in range(3)), pa.array(size)], names=["x", "y", "z", "size"])

    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = written(docs.select("text").mapInArrow(work, "x double, y double, z double, size long"), "points")
    at = [k / CELLS for k in range(1, CELLS)]
    found = points.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in "xyz"]).first()
    edges = np.array([found[c] if found[c] is not None else [0.0] * (CELLS - 1) for c in "xyz"])

    def stretches(batches):
        import pyarrow as pa

        total = np.zeros(1 << STRETCH, np.int64)
        for batch in batches:
            keys = curve_keys(np.stack([batch.column(d).to_numpy() for d in range(3)], axis=1), edges)
            np.add.at(total, keys >> (3 * BITS - STRETCH), batch.column(3).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "size"])

    sizes = np.zeros(1 << STRETCH, np.int64)
    rows = points.mapInArrow(stretches, "at long, size long").groupBy("at").agg(F.sum("size").alias("size")).toArrow()
    sizes[rows.column("at").to_numpy()] = rows.column("size").to_numpy()
    discard(points)
    return edges, *shares(sizes, tasks), tasks


def _runs(n: int, length: int) -> Iterator[int]:
    """A rest of n < length ids in powers of two, largest first."""
    while n:
        yield (run := 1 << (n.bit_length() - 1))
        n -= run


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: which ids of which document stand where in which sequence; ``with_ids`` adds them as little-endian unsigned 32-bit numbers."""
    path = tokenizer or tokenizer_path()
    key = row_key()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key["id"].alias("id"), key["h"].alias("h"))
    edges, first, number, tasks = _layout(docs)

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            curve = curve_keys(projections(batch.column("text")), edges)
            at, h = curve >> (3 * BITS - STRETCH), batch.column("h").to_numpy() ^ batch.column("id").to_numpy()
            task = first[at] + (mix(h.view(np.uint64)) % number[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve), pa.array(task.astype(np.int32))], names=["doc_id", "text", "id", "h", "curve", "task"])

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        room = length
        tail: list[list] = []  # the open sequence's pieces; its lengths are settled when it is full or the task ends

        def table(rows):
            cols = list(zip(*rows))
            out = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            if with_ids:
                out, names = [*out, pa.array(cols[7], pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(out, names=names)

        def row(doc, start, ids, total, seq, offset):
            return (doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset, ids)

        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").fill_null("").to_pylist()
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                    ids += end
                    total, start = len(ids) // 4, 0
                    while start < total:
                        take = min(room, total - start)
                        tail.append([doc, start, ids[4 * start : 4 * (start + take)], total])
                        start, room = start + take, room - take
                        if not room:
                            offset = 0
                            for d, s, i, t in tail:
                                done.append(row(d, s, i, t, sequence, offset))
                                offset += len(i) // 4
                            sequence, room, tail = sequence + 1, length, []
            if done:
                yield table(done)
        done = []
        for run in _runs(length - room, length):
            offset = 0
            while offset < run:
                d, s, i, t = tail.pop(0)
                take = min(run - offset, len(i) // 4)
                done.append(row(d, s, i[: 4 * take], t, sequence, offset))
                if 4 * take < len(i):
                    tail.insert(0, [d, s + take, i[4 * take :], t])
                offset += take
            sequence += 1
        if done:
            yield table(done)

    df = docs.mapInArrow(placed, "doc_id long, text string, id long, h long, curve long, task int").repartitionById(tasks, "task").sortWithinPartitions("curve", "id", "h")
    return df.select("doc_id", "text").mapInArrow(work, SCHEMA + (", ids binary" if with_ids else ""))
