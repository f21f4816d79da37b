"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashed coordinates of its words, of neighbouring words, and of pairs of words with one or two words
between them, each counted once however often it occurs.  Words are runs of letters, digits and characters beyond ASCII in lower case.

Training takes ``ToxicityParams.per_class`` labelled rows of either class at about (all, where there are fewer), chosen by
a hash of their id over the whole table; this is the documented bound of the one task that fits.  Features of these rows are
made where the rows lie.  Each coordinate has its own learning rate, and the L1 term leaves all but a few coordinates at zero,
so what is broadcast to score every document is small, and never more than 2**bits coordinates.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; the others are held out.  Nothing but the text is an input
of a score.

Edge cases: a null or empty text has no features and scores the intercept; a null doc_id counts as the empty text for the remainder, so
it is held out, and it has no label; of several labels of an id the largest counts; null labels are none; without labels of both
classes every score is 0; repeated rows score alike; an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import ALNUM, batches_of_texts, mix, words
from .common import discard, utf8, written

BATCH_BYTES = 1 << 20
#: Odd constants, one for each distance of two words.
PAIRS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class ToxicityParams:
    """alpha, beta, l1, l2: of FTRL-proximal; epochs: passes over the training rows; fold, folds: what is held out."""

    bits: int = 22
    per_class: int = 10_000
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.2
    epochs: int = 4
    folds: int = 5
    fold: int = 0


@dataclass(frozen=True)
class Model:
    """Coordinates with a weight, and the intercept; None where there was nothing to learn from."""

    bits: int
    intercept: float | None
    coords: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)


def held_out(doc_id: Column | str, p: ToxicityParams = ToxicityParams()) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % p.folds == p.fold


def features(data: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every occurrence of a feature in the texts ``data[starts[i]:starts[i + 1]]``."""
    h, bounds = words(data, starts, ALNUM)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(bounds))
    shift = np.uint64(64 - bits)
    texts, coords = [text], [h >> shift]
    for gap, c in enumerate(PAIRS, 1):
        if len(h) > gap:
            both = np.flatnonzero(text[gap:] == text[:-gap])
            texts.append(text[both])
            coords.append(mix(h[both] * np.uint64(c) + h[both + gap]) >> shift)
    return np.concatenate(texts), np.concatenate(coords).astype(np.int64)


def _featured(df: DataFrame, bits: int) -> DataFrame:
    """(key, y, x): each row's distinct coordinates, sorted."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            data, starts = utf8(batch.column("text"))
            for lo, hi in batches_of_texts(starts, BATCH_BYTES):
                part = starts[lo : hi + 1]
                text, coord = features(data[part[0] : part[-1]], part - part[0], bits)
                own = np.unique((text << bits) | coord)
                ends = np.searchsorted(own >> bits, np.arange(hi - lo + 1))
                x = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((own & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), x], names=["key", "y", "x"])

    return df.select("key", "y", "text").mapInArrow(work, "key long, y int, x array<int>")


def ftrl(rows: list[np.ndarray], labels: np.ndarray, p: ToxicityParams) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, coordinates, weights) after ``epochs`` passes in the given order.

    z and n of each coordinate are kept; a weight is -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2) where |z| > l1, else 0.
    The intercept has its own rate and no penalty.
    """
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    z0 = n0 = 0.0

    def intercept() -> float:
        return -z0 * p.alpha / (p.beta + n0**0.5)

    for _ in range(p.epochs):
        for j, y in zip(rows, labels.tolist()):
            zj, nj = z[j], n[j]
            root = np.sqrt(nj)
            w = np.where(np.abs(zj) > p.l1, (np.sign(zj) * p.l1 - zj) / ((p.beta + root) / p.alpha + p.l2), 0.0)
            w0 = intercept()
            g = 1 / (1 + np.exp(-np.clip(w0 + w.sum(), -35, 35))) - y
            z[j] = zj + g - (np.sqrt(nj + g * g) - root) / p.alpha * w
            n[j] = nj + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / p.alpha * w0
            n0 += g * g
    w = np.where(np.abs(z) > p.l1, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2), 0.0)
    some = np.flatnonzero(w)
    return intercept(), some, w[some]


def training_rows(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(key, y, text): the labelled rows that may be learned from, ``per_class`` of either class at about.

    Their number is counted first; with more than the bound, ids whose hash lies under the bound's share are taken.  What is
    broadcast is these ids.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    open_ = known.where(~held_out("__id", p))
    many = {r.y: r.n for r in open_.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    key = F.xxhash64(F.lit(11), "__id")
    share = F.lit(0)
    for y, n in many.items():
        share = F.when(F.col("y") == y, F.lit(round(min(1.0, p.per_class / n) * (1 << 20)))).otherwise(share)
    few = open_.where(F.pmod(key, F.lit(1 << 20)) < share).select("__id", "y", key.alias("key"))
    if len(many) < 2:
        few = few.where("false")
    return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("key", "y", F.lower("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> Model:
    """Learns from :func:`training_rows`.  One task fits the bounded rows in the order of their ids' hash, so equal tables give equal weights."""
    rows = written(_featured(training_rows(docs, labels, p), p.bits), "toxicity-features")

    def work(batches):
        import pyarrow as pa

        xs, ys = [], []
        for batch in batches:
            ys.append(batch.column("y").to_numpy())
            x = batch.column("x")
            values, ends = x.values.to_numpy(), x.offsets.to_numpy()
            xs += [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        if not xs:
            return
        w0, coords, weights = ftrl(xs, np.concatenate(ys).astype(np.float64), p)
        yield pa.RecordBatch.from_pydict({"coord": pa.array(np.concatenate([[-1], coords]), pa.int64()), "weight": pa.array(np.concatenate([[w0], weights]))})

    got = rows.repartition(1).sortWithinPartitions("key", F.hash("x")).mapInArrow(work, "coord long, weight double").toPandas().sort_values("coord")
    discard(rows)
    if not len(got):
        return Model(p.bits, None, np.zeros(0, np.int64), np.zeros(0))
    return Model(p.bits, float(got.weight.iloc[0]), got.coord.to_numpy()[1:].copy(), got.weight.to_numpy()[1:].copy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.intercept, model.coords, model.weights))
    bits = model.bits

    def work(batches):
        import pyarrow as pa

        w0, coords, weights = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[coords] = weights
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            for lo, hi in batches_of_texts(starts, BATCH_BYTES):
                part = starts[lo : hi + 1]
                if w0 is None:
                    s = np.zeros(hi - lo)
                else:
                    text, coord = features(data[part[0] : part[-1]], part - part[0], bits)
                    some = dense[coord] != 0
                    own = np.unique((text[some] << bits) | coord[some])
                    total = np.bincount(own >> bits, weights=dense[own & ((1 << bits) - 1)].astype(np.float64), minlength=hi - lo)
                    s = 1 / (1 + np.exp(-np.clip(w0 + total, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(work, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every document; fitting runs when this is called."""
    s = score(docs, model or fit(docs, labels, p))
    return s.select("doc_id", held_out("doc_id", p).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def evaluate(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(held_out, n, toxic, true_positive, false_positive, log_loss) of the labelled rows of :func:`toxicity`'s result."""
    known = labels.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    q = F.least(F.greatest("score", F.lit(1e-12)), F.lit(1 - 1e-12))
    both = scored.join(known, "doc_id").where("y is not null")
    return both.groupBy("held_out").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"), F.sum(F.col("y") * F.col("predicted")).alias("true_positive"), F.sum((1 - F.col("y")) * F.col("predicted")).alias("false_positive"),
        F.avg(-F.log(F.when(F.col("y") == 1, q).otherwise(1 - q))).alias("log_loss"),
    )
