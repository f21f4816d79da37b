"""Token files by a static range asymmetric numeral system (rANS).

An image holds whole documents' ids, about ``IMAGE_TOKENS`` of them: one frequency table that all its blocks share, then
blocks of ``BLOCK_TOKENS`` ids that decode independently.  Within a block ``LANES`` coders are interleaved: lane j
codes ids j, j + LANES, ..., all lanes step together as numpy vectors.  A block starts with its checkpoint, the lanes'
states; the index has each block's place and the CRC-32 of its ids, which reading verifies.

Images are rows of a Parquet table: Spark writes them to any store, commits them atomically and reads them in parallel.

Edge cases: a null or empty text is the end id alone; null doc_ids come first; repeated rows are written each; an
empty table gives an empty file set and no rows; other input columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key
from .tokens import encoder, tokenizer_path

MAGIC = b"ATSRANS1"
SCALE_BITS = 18
LANES = 1024
BLOCK_TOKENS = 1 << 18
IMAGE_TOKENS = 1 << 20
LOW = np.uint64(1 << 31)
IMAGE_SCHEMA = "shard int, part int, before long, n_tokens long, n_docs long, image binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def frequencies(ids: np.ndarray, bits: int = SCALE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, freqs): counts scaled to sum to 2**bits, each at least 1."""
    symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << bits
    if len(symbols) > total:
        raise ValueError("more symbols than slots")
    freqs = np.maximum(1, counts * (total - len(symbols)) // counts.sum())
    spare = total - int(freqs.sum())
    freqs[np.argmax(counts)] += spare  # never negative: the floors sum to total - len(symbols) at most, plus one for each symbol
    if freqs.min() < 1:
        order = np.argsort(-freqs)
        raise ValueError(f"bad table {order[:3]}")
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def encode_block(index: np.ndarray, freqs: np.ndarray, cums: np.ndarray, bits: int = SCALE_BITS, lanes: int = LANES) -> bytes:
    """Symbol indexes to states (8 bytes a lane) and 32-bit words, in the order in which decoding reads them."""
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    shift, b = np.uint64(32), np.uint64(bits)
    limit = np.uint64(((1 << 31) >> bits) << 32)
    for step in range((len(index) - 1) // lanes, -1, -1):
        sym = index[step * lanes : (step + 1) * lanes]
        x, f = state[: len(sym)], freqs[sym]
        full = x >= limit * f
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> shift, x)
        else:
            words.append(np.zeros(0, "<u4"))
        q = x // f
        state[: len(sym)] = (q << b) + (x - q * f) + cums[sym]
    return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, slots: np.ndarray, freqs: np.ndarray, cums: np.ndarray, bits: int = SCALE_BITS, lanes: int = LANES) -> np.ndarray:
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes)
    out, at = np.empty(n, np.uint32), 0
    mask, b, shift = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    for lo in range(0, n, lanes):
        m = min(lanes, n - lo)
        x = state[:m]
        slot = x & mask
        sym = slots[slot]
        out[lo : lo + m] = sym
        x = freqs[sym] * (x >> b) + slot - cums[sym]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << shift) | words[at : at + len(need)].astype(np.uint64)
            at += len(need)
        state[:m] = x
    if at != len(words) or (state != LOW).any():  # the coders end where they began
        raise ValueError("a block is damaged")
    return out


def _packed(a: np.ndarray, kind: str) -> bytes:
    z = zlib.compress(np.diff(a, prepend=a.dtype.type(0)).astype(kind).tobytes(), 1)
    return struct.pack("<I", len(z)) + z


def _unpacked(data: memoryview, at: int, kind: str) -> tuple[np.ndarray, int]:
    (n,) = struct.unpack_from("<I", data, at)
    return np.cumsum(np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), kind), dtype=kind), at + 4 + n


def write_image(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """An image of documents' ids, in order."""
    symbols, freqs = frequencies(ids)
    cums = np.concatenate([[0], np.cumsum(freqs)])[:-1].astype(np.uint64)
    index = np.searchsorted(symbols, ids)
    f = freqs.astype(np.uint64)
    blocks = [encode_block(index[i : i + BLOCK_TOKENS], f, cums) for i in range(0, len(ids), BLOCK_TOKENS)]
    crcs = [zlib.crc32(ids[i : i + BLOCK_TOKENS].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK_TOKENS)]
    nulls = np.array([d is None for d in docs], np.uint8)
    parts = [
        _packed(np.array([d or 0 for d in docs], np.int64), "<i8"),
        _packed(nulls.astype(np.int64), "<i8"),
        _packed(np.array(lengths, np.int64), "<i8"),
        _packed(symbols.astype(np.int64), "<i8"),
        _packed(freqs.astype(np.int64), "<i8"),
        _packed(np.array([len(x) for x in blocks], np.int64), "<i8"),
        _packed(np.array(crcs, np.int64), "<i8"),
    ]
    return MAGIC + struct.pack("<QIIB", len(ids), LANES, BLOCK_TOKENS, SCALE_BITS) + b"".join(parts) + b"".join(blocks)


def read_image(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of an image; a wrong checksum raises."""
    view = memoryview(data)
    if bytes(view[:8]) != MAGIC:
        raise ValueError("not a token image")
    n, lanes, block, bits = struct.unpack_from("<QIIB", view, 8)
    at, cols = 8 + struct.calcsize("<QIIB"), []
    for _ in range(7):
        col, at = _unpacked(view, at, "<i8")
        cols.append(col)
    docs, nulls, lengths, symbols, freqs, sizes, crcs = cols
    cums = np.concatenate([[0], np.cumsum(freqs)])[:-1].astype(np.uint64)
    slots = np.repeat(np.arange(len(symbols), dtype=np.uint32), freqs)
    out, f = np.empty(n, "<u4"), freqs.astype(np.uint64)
    for k, (size, crc) in enumerate(zip(sizes.tolist(), crcs.tolist())):
        lo = k * block
        m = min(block, n - lo)
        ids = symbols[decode_block(bytes(view[at : at + size]), m, slots, f, cums, bits, lanes)].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        out[lo : lo + m], at = ids, at + size
    return [None if z else d for d, z in zip(docs.tolist(), nulls.tolist())], lengths, out


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None) -> None:
    """Writes all documents' ids to ``path`` in ascending doc_id order: shard, then part, then place in the image."""
    tok = tokenizer or tokenizer_path()

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = encoder(tok), np.array([end_id], "<u4").tobytes()
        shard, part, before, n = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def image():
            flat = np.frombuffer(b"".join(ids), "<u4")
            data = write_image(names, [len(x) // 4 for x in ids], flat)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "before": [before], "n_tokens": [n], "n_docs": [len(ids)], "image": pa.array([data], pa.binary())})

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                for d, x in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text").fill_null("").to_pylist())):
                    ids.append(x + end)
                    names.append(d)
                    n += len(x) // 4 + 1
                    if n >= IMAGE_TOKENS:
                        yield image()
                        part, before, n, ids, names = part + 1, before + n, 0, [], []
        if ids:
            yield image()

    key = row_key()
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("doc_id").isNotNull().alias("__set"), key["h"].alias("__h"))
    order = ["__set", "doc_id", "__h"]
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(work, IMAGE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document, from the files alone; ``start`` counts all ids before the document's."""
    images = spark.read.schema(IMAGE_SCHEMA).parquet(path)
    # one row for each shard, that is for each task that wrote: as many as there are partitions
    totals = images.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    base, at = {}, 0
    for r in totals:
        base[r.shard], at = at, at + r.n

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, before, image in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), batch.column("image")):
                docs, lengths, ids = read_image(image.as_py())
                raw, ends = memoryview(ids.tobytes()), np.cumsum(lengths)
                starts = ends - lengths
                own = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                cols = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts + (base[shard] + before)), "n_tokens": pa.array(lengths), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([bytes(x) for x in own], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return images.select("shard", "before", "image").mapInArrow(work, DOC_SCHEMA + (", ids binary" if with_ids else ""))
