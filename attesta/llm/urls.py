"""URL filters: rules first, then a ratio of two character language models.

The models are smoothed variable-order Markov models of accepted and of rejected URLs: the chance of a character after
its last k characters is that after its last k - 1, corrected by what was counted, for k up to ``order``.  Labels are what the rules
say, or a table of labelled URLs beside them.  Counts cover every labelled URL but each fifth by hash, which is held out; on those the
threshold for the mean log-likelihood difference a character is calibrated.

Each order counts in a table of its own, of ``slots`` hashed cells at most, for contexts and for contexts with a character: a fixed size, so
what tasks emit, the shuffle of a task, the driver's copy and the broadcast are bounded whatever the input.  Orders of up to two characters have
a cell for each string; longer contexts that share a cell are counted together, and an order's table fills as the labelled URLs' different contexts near ``slots``.

Edge cases: a null url, or one without "://", has an empty host and path and no rule, and its characters are those of an empty text: it
scores 0 and is allowed unless the threshold is positive; null ids pass through; repeated rows get equal results; an empty table
gives an empty table; with labels of one class only, URLs without a rule get that class's verdict, and without any label they are allowed;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import mix
from .common import utf8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path), tried from the longest to the shortest.
RULES = (("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/"))


@dataclass(frozen=True)
class UrlParams:
    order: int = 5
    #: cells of an order's table; low orders need fewer
    slots: int = 1 << 20
    strength: float = 4.0
    held_out: int = 5
    bins: int = 400

    def layout(self) -> list[tuple[int, int]]:
        """(first cell, number of cells) of each order's table."""
        sizes = [min(self.slots, 256 ** (k + 1)) for k in range(self.order + 1)]
        return [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]

    def cells(self) -> int:
        return sum(n for _, n in self.layout())


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), ALPHABET, ALPHABET.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """The longest rule that fits, as host and path; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    return F.coalesce(*[F.when(((h == r[1]) | h.endswith("." + r[1])) & p.startswith(r[2]), F.lit(r[1] + r[2])) for r in ordered])


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    df = df.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    verdict = {h + p: v for v, h, p in rules}
    return df.withColumn("by_rule", F.coalesce(*[F.when(F.col("rule") == k, F.lit(v)) for k, v in verdict.items()]))


def contexts(texts, params: UrlParams):
    """(text, number of texts, contexts, contexts with it): for each character its text and, by order, the cells of its context and of the context with it."""
    data, starts = utf8(texts)
    order, n = params.order, np.diff(starts)
    text = np.repeat(np.arange(len(n)), n)
    padded = np.ones(len(data) + order * len(n), np.uint64)  # 1 stands before a text
    place = np.arange(len(data)) + order * (text + 1)
    padded[place] = data
    context, with_it = [], []
    h = exact = np.zeros(len(data), np.uint64)
    for k, (first, size) in enumerate(params.layout()):
        if k:
            before = padded[place - k]
            h, exact = mix(h * np.uint64(257) + before + np.uint64(1)), exact + (before << np.uint64(8 * k))
        if size == 256 ** (k + 1):  # a cell for each string
            context.append(first + (exact >> np.uint64(8)).astype(np.int64))
            with_it.append(first + (exact + padded[place]).astype(np.int64))
        else:
            context.append(first + (mix(h + np.uint64(k)) % np.uint64(size)).astype(np.int64))
            with_it.append(first + (mix(h * np.uint64(31) + padded[place] + np.uint64(1000 + k)) % np.uint64(size)).astype(np.int64))
    return text, len(n), context, with_it


def log_chances(context, with_it, seen: np.ndarray, after: np.ndarray, strength: float) -> np.ndarray:
    """The log chance of each character under the counts of contexts and of contexts with a character."""
    p = np.full(len(context[0]) if context else 0, 1 / 256)
    for c, w in zip(context, with_it):
        p = (np.minimum(after[w], seen[c]) + strength * p) / (seen[c] + strength)
    return np.log(p)


class Tables:
    """Counts by class and kind, sent as the cells that hold any and laid out at their first use in a process."""

    def __init__(self, cell: np.ndarray, n: np.ndarray, cells: int):
        self.rows = cell.astype(np.int32), n.astype(np.int32 if len(n) == 0 or n.max() < 2**31 else np.int64), cells
        self.full: np.ndarray | None = None

    def __reduce__(self):
        return Tables, self.rows

    def dense(self) -> np.ndarray:
        """[class, kind, cell]; class 1 is accepted, kind 0 counts contexts and kind 1 contexts with a character."""
        if self.full is None:
            cell, n, cells = self.rows
            self.full = np.zeros(4 * cells, n.dtype)
            self.full[cell] = n
        return self.full.reshape(2, 2, -1)


def fit(df: DataFrame, params: UrlParams = UrlParams(), labels: DataFrame | None = None):
    """(broadcast :class:`Tables`, threshold) from ``parsed`` rows and ``labels`` (url, accepted boolean)."""
    labelled = df.where((F.col("host") != "") & F.col("by_rule").isNotNull()).select("url", (F.col("by_rule") == "allow").cast("int").alias("label"))
    if labels is not None:
        labelled = labelled.unionByName(labels.where("url is not null and accepted is not null").select(F.col("url").cast("string").alias("url"), F.col("accepted").cast("int").alias("label")))
    labelled = labelled.select(F.lower("url").alias("url"), "label", (F.pmod(F.xxhash64("url"), F.lit(params.held_out)) == 0).alias("held"))
    cells = params.cells()

    def count(batches):
        import pyarrow as pa

        total = np.zeros((2, 2, cells), np.int64)
        for batch in batches:
            text, _, context, with_it = contexts(batch.column("url"), params)
            label = batch.column("label").to_numpy()[text]
            for c in (0, 1):
                for kind, all_ in ((0, context), (1, with_it)):
                    for x in all_:
                        cell, n = np.unique(x[label == c], return_counts=True)
                        total[c, kind, cell] += n
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(some), "n": pa.array(flat[some])})

    rows = labelled.where("not held").select("url", "label").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    # 4 * cells numbers at most
    shared = df.sparkSession.sparkContext.broadcast(Tables(rows.column("cell").to_numpy(), rows.column("n").to_numpy(), cells))
    held = labelled.where("held").withColumn("score", scorer(shared, params)("url"))
    edge = F.least(F.greatest(F.floor(F.col("score") * params.bins / 4), F.lit(-params.bins)), F.lit(params.bins - 1))
    hist = held.groupBy("label", edge.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    return shared, _threshold([(r.label, r.bin, r.n) for r in hist], params)


def _threshold(hist: list[tuple[int, int, int]], params: UrlParams) -> float:
    """The smallest edge of the best balanced accuracy; with one class only, all or nothing."""
    total = {c: sum(n for k, _, n in hist if k == c) for c in (0, 1)}
    if not total[0] or not total[1]:
        return float("-inf") if total[1] or not total[0] else float("inf")
    best, at = -1.0, 0
    for edge in sorted({b for _, b, _ in hist} | {b + 1 for _, b, _ in hist}):
        good = sum(n for k, b, n in hist if k == 1 and b >= edge) / total[1] + sum(n for k, b, n in hist if k == 0 and b < edge) / total[0]
        if good > best + 1e-12:
            best, at = good, edge
    return at * 4 / params.bins


def scorer(shared, params: UrlParams):
    @F.arrow_udf("double")
    def score(urls):
        import pyarrow as pa

        tables = shared.value.dense()
        text, n, context, with_it = contexts(urls, params)
        diff = log_chances(context, with_it, tables[1, 0], tables[1, 1], params.strength) - log_chances(context, with_it, tables[0, 0], tables[0, 1], params.strength)
        return pa.array(np.bincount(text, diff, minlength=n) / np.maximum(np.bincount(text, minlength=n), 1))

    return score


def filter_urls(pages: DataFrame, params: UrlParams = UrlParams(), rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict of each page; ``labels`` (url, accepted) adds to what the rules say."""
    df = parsed(pages, rules)
    shared, threshold = fit(df, params, labels)
    text = F.when(F.col("host") != "", F.lower("url")).otherwise("")
    df = df.withColumn("score", F.round(scorer(shared, params)(text), 9))
    by_model = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return df.withColumn("verdict", F.coalesce("by_rule", by_model)).drop("by_rule")
