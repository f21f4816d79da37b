"""Quality rules: counts from each text, and the log-likelihood ratio of its hashed n-grams.

Words are runs of anything but ASCII white space.  Two multinomials over hashed word unigrams and bigrams are
fitted: the trusted target on labelled good documents, the raw corpus on every document.  A document's score is the
sum over its n-grams of log(target / raw), by their number and a constant; one whose score is under the threshold is rejected.

Only DataFrame functions: counts come from arrays inside a row, the bucket counts from one aggregation whose
shuffle holds at most ``buckets`` rows a task, and the weights (``buckets`` numbers, a fixed size) go into the plan
as a literal.  Texts are shuffled once, to the labels' ids, where these are too many for Spark to broadcast.

Edge cases: a null or empty text has no words and fails the base rules; null doc_ids pass through; repeated rows are
judged alike; an empty table gives an empty table; without usable labels the threshold is minus infinity and only
the base rules reject; columns of the input whose names clash with the result's give way to the latter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, discard, free_name, let, replaced, written

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityParams:
    """The target model and the threshold come from every labelled document, the raw counts from all documents."""

    #: over 0.1 GB of labelled documents, 2**14 keep 3 of 1,370 low-quality ones and all but 1 of 2,112 toxic ones, 2**16 none and 1,999, 2**18
    #: none and 1,979; the weights stand in the plan as a literal, and with 2**16 plans took the driver past 1,500 MB in the check tool's pipeline
    buckets: int = 1 << 14
    smoothing: float = 1.0
    #: each so many-th of them by hash is held out from the target model, and sets the threshold
    held_out: int = 5
    #: share of the held-out trusted documents that the threshold may reject at most
    reject_share: float = 0.001
    #: how far under that share's score the threshold lies, unless some held-out rejected document lies between
    margin: float = 0.02
    #: added to a document's number of n-grams, so that a short one needs more evidence
    prior_length: int = 50
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def covered_words(hashes: Column, window: int) -> Column:
    """How many words lie in windows whose hash occurs twice or more; ``hashes`` holds one hash a window, in order."""

    def spread(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def total(p: Column) -> Column:
        gaps = F.arrays_zip(p.alias("a"), F.slice(p, 2, F.size(p)).alias("b"))
        return F.aggregate(gaps, F.lit(0), lambda acc, z: acc + F.least(F.lit(window), F.coalesce(z["b"] - z["a"], F.lit(window))))

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return let(let(F.sort_array(placed), spread), total)


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def counts(text: Column, params: QualityParams, score=None) -> Column:
    """A struct of the base counts and ``base_failed``; with ``score``, of words and their hashes, also its ``llr`` for texts that don't fail.

    One expression in which each step is computed once, so that a filter on it costs no more than its value.
    """
    k = params.window

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))

    def repeated(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) < F.size(win), covered_words(win, k)).otherwise(0)

    def of_words(parts: Column, w: Column, h: Column) -> Column:
        base = {"n_words": F.size(w), "word_chars": F.length(text) - F.size(parts) + 1, "n_repeat_words": let(windows(h), repeated)}
        base |= {"n_symbols": F.size(F.split(text, SYMBOLS)) - 1, "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))}

        def judged(b: Column) -> Column:
            failed = (b["n_words"] < params.min_words) | (100 * b["n_repeat_words"] > params.max_repeat_percent * b["n_words"])
            out = [b[c].alias(c) for c in base] + [failed.alias("base_failed")]
            return F.struct(*out, *([F.when(~failed, score(w, h)).alias("llr")] if score else []))

        return let(F.struct(*[v.cast("long").alias(c) for c, v in base.items()]), judged)

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.split(text, WS), lambda parts: let(F.array_remove(parts, ""), lambda w: let(hashes(w), lambda h: of_words(parts, w, h))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measured(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` with the base counts and ``base_failed``."""
    found, name = counts(F.coalesce(F.col("text"), F.lit("")), params), free_name(docs, "counts")
    return replaced(docs.withColumn(name, found), {c: F.col(name)[c] for c in COUNTS}).drop(name)


def ngram_buckets(w: Column, h: Column, params: QualityParams) -> Column:
    """The hash bucket of each word, whatever its case, and of each pair of neighbouring words."""
    n = F.lit(params.buckets)
    ones = F.transform(w, lambda x: F.pmod(F.xxhash64(F.lower(x)), n).cast("int"))
    twos = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), n).cast("int"))
    return F.concat(ones, twos)


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    threshold: float


def labelled_ids(labels: DataFrame, trusted: bool = True) -> DataFrame:
    """The trusted ids (quality 1, not toxic), or the rejected ones (quality 0 or toxic)."""
    good = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return labels.where((good if trusted else bad) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with these ids, which are as many as labels: never broadcast, so small and large inputs shuffle the same share."""
    return docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")


def score(w: Column, h: Column, model: QualityModel, params: QualityParams) -> Column:
    """Log-likelihood ratio by length: the n-grams' sum over their number and ``prior_length``; null without any."""
    table = F.split(F.lit(",".join(f"{x:.5g}" for x in model.weights)), ",").cast("array<double>")
    return let(ngram_buckets(w, h, params), lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(table, x)) / (F.size(b) + params.prior_length)))


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Counts the n-grams of every document, and those of every trusted one beside; what reaches the driver has ``buckets`` rows, and few more for the threshold."""
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(params.held_out)) == 0
    # one type of id on both sides, so that its hash is one
    labels = labels.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
    known = labelled_ids(labels)

    def grams(d: DataFrame, t: int) -> DataFrame:
        found = let(words(F.col("text")), lambda w: let(hashes(w), lambda h: ngram_buckets(w, h, params)))
        return d.select(F.lit(t).alias("t"), F.explode(found).alias("b"))

    both = grams(docs, 0).unionByName(grams(labelled(docs.where(~held), known.where(~held)), 1))
    rows = both.groupBy("b").agg(F.sum(1 - F.col("t")).alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [0] * params.buckets, [0] * params.buckets
    for r in rows:
        raw[r.b], target[r.b] = r.raw, r.target
    a, n = params.smoothing, params.buckets
    r_all, t_all = sum(raw) + a * n, sum(target) + a * n
    weights = tuple(math.log((t + a) / t_all) - math.log((r + a) / r_all) for t, r in zip(target, raw))
    model = QualityModel(weights, float("-inf"))
    if not sum(target):
        return model
    # the threshold: a low percentile of the scores of trusted documents that the target model hasn't seen, less a margin if that loses no rejected one
    asked = known.where(held).withColumn("good", F.lit(True)).unionByName(labelled_ids(labels, trusted=False).where(held).withColumn("good", F.lit(False)))
    whole = let(words(F.col("text")), lambda w: F.when(F.size(w) >= params.min_words, let(hashes(w), lambda h: score(w, h, model, params))))
    # scores meet the labels, not texts: a number for each held-out id, and for its repeated rows
    found = written(docs.where(held).select("doc_id", whole.alias("s")).join(asked, "doc_id").select("good", "s"), "held-out")
    seen = found.where("good and s is not null")
    place = (seen.count() - 1) * params.reject_share
    if place < 0:
        discard(found)
        return model
    least = [r.s for r in seen.select("s").orderBy("s").offset(int(place)).limit(2).collect()]
    low = least[0] + (least[-1] - least[0]) * (place - int(place))
    near = ~F.col("good") & (F.col("s") < F.lit(low)) & (F.col("s") >= F.lit(low - params.margin))
    between = found.agg(F.max(near.cast("int")).alias("any")).first().any
    discard(found)
    return QualityModel(weights, low if between else low - params.margin)


def judge(docs: DataFrame, model: QualityModel, params: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``llr`` and ``kept``."""
    found = counts(F.coalesce(F.col("text"), F.lit("")), params, lambda w, h: score(w, h, model, params))
    name = free_name(docs, "counts")
    q = F.col(name)
    kept = ~q["base_failed"] & F.coalesce(q["llr"] >= F.lit(model.threshold), F.lit(True))
    return replaced(docs.withColumn(name, found), {**{c: q[c] for c in COUNTS}, "llr": q["llr"], "kept": kept}).drop(name)


def quality_rules(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Fits on all of ``docs`` and judges each of them."""
    return judge(docs, fit(docs, labels, params), params)
