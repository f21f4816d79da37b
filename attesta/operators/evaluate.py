"""Evaluation and diagnostics as aggregates: hit rates, refusals, floors, threshold sweeps, confusion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import in_order, running

# Which mode a refusal of each source has.
REFUSAL_MODES = {"gate": "refused-gate", "preflight": "refused-preflight", "generation": "refused-generation"}
BUDGETS = (0, 1, 2)


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("long"))


def hit_at_k(kept: DataFrame, key: DataFrame) -> DataFrame:
    """(question_id, hit): any expected id is among those kept.  key: question_id, expected (array)."""
    ids = kept.groupBy("question_id").agg(F.collect_set("id").alias("ids"))
    return key.join(ids, "question_id", "left").select("question_id", F.coalesce(F.arrays_overlap("expected", "ids"), F.lit(False)).alias("hit"))


def citation_correct(cited: DataFrame, key: DataFrame) -> DataFrame:
    """(question_id, id_ok, basis_ok, render_ok, correct): three independent tests, each satisfied by any cited base id.

    cited: question_id, mode, base, basis, rendered; key: question_id, expected, expected_basis, expected_citation.
    """
    j = key.join(cited, "question_id", "left").withColumn("ok", F.array_contains("expected", F.col("base")))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    out = j.groupBy("question_id").agg(any_(F.col("mode") == "answered").alias("answered"), any_(F.col("ok")).alias("id_ok"), any_(F.col("ok") & (F.col("basis") == F.col("expected_basis"))).alias("basis_ok"), any_(F.col("ok") & F.contains("rendered", "expected_citation")).alias("render_ok"))
    return out.withColumn("correct", F.col("answered") & F.col("id_ok") & F.col("basis_ok") & F.col("render_ok"))


def refusal_correct(answers: DataFrame, key: DataFrame) -> DataFrame:
    """(question_id, refusal_source, mode, correct): the mode is that of the expected mechanism."""
    want = F.coalesce(*[F.when(F.col("refusal_source") == k, F.lit(v)) for k, v in REFUSAL_MODES.items()])
    return key.where("refusal_source is not null").join(answers, "question_id", "left").select("question_id", "refusal_source", "mode", F.coalesce(F.col("mode") == want, F.lit(False)).alias("correct"))


def summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: for each nullable boolean metric how many are true (``m_ok``) and how many not null (``m_of``), and whether all are true."""
    cols = [x for m in metrics for x in (count_if(F.col(m)).alias(f"{m}_ok"), F.count(m).alias(f"{m}_of"))]
    full = F.lit(True)
    for m in metrics:
        full = full & (F.col(f"{m}_ok") == F.col(f"{m}_of"))
    return rows.agg(*cols).withColumn("passed", full)


def floor_gap(scores: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """One row: highest negative, lowest positive, the clean gap's middle (null if they overlap) and how many lie in the overlap."""
    ends = scores.agg(F.max(F.when(~F.col(positive), F.col(score))).alias("max_out"), F.min(F.when(F.col(positive), F.col(score))).alias("min_in"))
    both = scores.select(F.col(score).alias("s")).join(F.broadcast(ends), (F.col("s") <= F.col("max_out")) & (F.col("s") >= F.col("min_in")))
    n = both.agg(F.count(F.lit(1)).alias("overlapping"))
    return ends.join(n).select("max_out", "min_in", F.when(F.col("max_out") < F.col("min_in"), F.round((F.col("max_out") + F.col("min_in")) / 2, 6)).alias("floor"), "overlapping")


def overlap(scores: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """The rows of ``scores`` between the lowest positive and the highest negative, both included: what no floor can part."""
    ends = scores.agg(F.max(F.when(~F.col(positive), F.col(score))).alias("__top"), F.min(F.when(F.col(positive), F.col(score))).alias("__low"))
    return scores.join(F.broadcast(ends), (F.col(score) <= F.col("__top")) & (F.col(score) >= F.col("__low"))).drop("__top", "__low")


def threshold_sweep(scores: DataFrame, by: list[str], score: str = "score", budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(by, budget, threshold, caught, false_refusals, margin): of the thresholds that refuse at most ``budget`` positives, the first that catches most negatives.

    A score under the threshold is refused; thresholds are the scores and one above them all (null).  Distinct scores are counted, sorted by
    range over all samples, and summed along both directions with what earlier stretches hold, so one sample may have
    any share of the scores.  The margin is the distance to the lowest positive at or above the threshold.
    """
    per = scores.groupBy(*by, F.col(score).alias("t")).agg(count_if(F.col("positive")).alias("p"), count_if(~F.col("positive")).alias("n"))
    up = running(in_order(per, by, ["t"], "scores"), by, {"pp": ("sum", F.col("p")), "nn": ("sum", F.col("n"))})
    below = running(up, by, {"next": ("min", F.when(F.col("p") > 0, F.col("t")))}, reverse=True)
    below = below.select(*by, "t", (F.col("pp") - F.col("p")).alias("false_refusals"), (F.col("nn") - F.col("n")).alias("caught"), "next")
    none = F.lit(None).cast(scores.schema[score].dataType)
    top = per.groupBy(*by).agg(F.sum("p").alias("false_refusals"), F.sum("n").alias("caught")).select(*by, none.alias("t"), "false_refusals", "caught", none.alias("next"))
    options = below.unionByName(top).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("false_refusals <= budget")
    first = F.min(F.struct((-F.col("caught")).alias("c"), F.col("t").isNull().alias("last"), "t", "false_refusals", "next"))
    best = options.groupBy(*by, "budget").agg(first.alias("x"))
    return best.select(*by, "budget", F.col("x.t").alias("threshold"), (-F.col("x.c")).alias("caught"), "x.false_refusals", F.round(F.col("x.next") - F.col("x.t"), 6).alias("margin"))


def or_sweep(scores: DataFrame, by: list[str], first: str, second: str, t1: list[float], t2: list[float], budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(by, budget, t1, t2, caught, false_refusals): refuse if either score is under its threshold; the best pair of two lists for each budget.

    Rows are first counted by the cell of the grid they fall into, so what the pairs are summed over has at most
    (len(t1) + 1) * (len(t2) + 1) rows a group, however many scores there are.
    """
    t1, t2 = sorted(set(t1)), sorted(set(t2))

    def at(ts: list[float], c: str) -> Column:
        """How many thresholds a score reaches; the score is bound first, so that it is computed once however it is made."""
        return F.transform(F.array(c), lambda s: F.size(F.filter(F.array(*[F.lit(float(t)) for t in ts]), lambda x: x <= s))).getItem(0)

    cell = scores.select(*by, "positive", at(t1, first).alias("i"), at(t2, second).alias("j")).groupBy(*by, "i", "j").agg(count_if(F.col("positive")).alias("p"), count_if(~F.col("positive")).alias("n"))
    grid = lambda ts, n, v: F.explode(F.array(*[F.struct(F.lit(k + 1).alias(n), F.lit(float(t)).alias(v)) for k, t in enumerate(ts)]))
    pairs = cell.withColumn("a", grid(t1, "x", "t1")).withColumn("b", grid(t2, "y", "t2"))
    refused = ~((F.col("i") >= F.col("a.x")) & (F.col("j") >= F.col("b.y")))
    every = pairs.groupBy(*by, F.col("a.t1").alias("t1"), F.col("b.t2").alias("t2")).agg(F.sum(F.when(refused, F.col("p")).otherwise(0)).alias("false_refusals"), F.sum(F.when(refused, F.col("n")).otherwise(0)).alias("caught"))
    options = every.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).where("false_refusals <= budget")
    order = Window.partitionBy(*by, "budget").orderBy(F.desc("caught"), "t1", "t2")
    return options.withColumn("r", F.row_number().over(order)).where("r = 1").select(*by, "budget", "t1", "t2", "caught", "false_refusals")


def band_breakdown(rows: DataFrame, band: str, first: Column, second: Column) -> DataFrame:
    """(band, n, first, second, either): how many rows each of two tests catches."""
    return rows.groupBy(F.col(band).alias("band")).agg(F.count(F.lit(1)).alias("n"), count_if(first).alias("first"), count_if(second).alias("second"), count_if(first | second).alias("either"))


def uncatchable(scores: DataFrame, first: str, t1: float, second: str, t2: float) -> DataFrame:
    """Negatives at or above both thresholds, the highest second score first."""
    return scores.where(~F.col("positive") & (F.col(first) >= t1) & (F.col(second) >= t2)).orderBy(F.desc(second), F.desc(first))


def collect_scores(sets: dict[str, DataFrame]) -> DataFrame:
    """Score sets with their own extra columns, under one header and a column ``sample``."""
    out = None
    for name, df in sets.items():
        df = df.withColumn("sample", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def modes_by_band(answers: DataFrame, band: str = "band", mode: str = "mode") -> DataFrame:
    """(band, n, answered, refused_gate, refused_preflight, refused_generation)."""
    return answers.groupBy(F.col(band).alias("band")).agg(F.count(F.lit(1)).alias("n"), *[count_if(F.col(mode) == m).alias(m.replace("-", "_")) for m in ("answered", *REFUSAL_MODES.values())])


def confusion(rows: DataFrame, by: list[str], truth: str = "truth", verdict: str = "verdict") -> DataFrame:
    """(by, n, caught, missed, false_refusals, ok): truth is in or out, the verdict pass or refuse."""
    out, refuse = F.col(truth) == "out", F.col(verdict) == "refuse"
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_if(out & refuse).alias("caught"), count_if(out & ~refuse).alias("missed"), count_if(~out & refuse).alias("false_refusals"), count_if((F.col(verdict) == "pass") == (F.col(truth) == "in")).alias("ok"))


def verdict_flips(base: DataFrame, new: DataFrame, id_: str = "id", verdict: str = "verdict") -> DataFrame:
    """(id, before, after) of rows in both runs whose verdict changed."""
    b, n = base.select(F.col(id_).alias("id"), F.col(verdict).alias("before")), new.select(F.col(id_).alias("id"), F.col(verdict).alias("after"))
    return n.join(b, "id").where("before <> after").select("id", "before", "after")


def still_answered(baseline: DataFrame, preflight: DataFrame) -> DataFrame:
    """Rows that the baseline answered and the pre-flight refuses."""
    return baseline.where("mode = 'answered'").join(preflight.where("verdict = 'refuse'").select("id"), "id", "left_semi")


def decision(rows: DataFrame, catch: int = 12, false: int = 1) -> DataFrame:
    """One row: caught and false refusals without debatable rows, and whether the rule set beforehand is met."""
    clear = rows.where(~F.coalesce(F.col("debatable"), F.lit(False)))
    c = confusion(clear, [])
    return c.select("caught", "false_refusals", ((F.col("caught") >= catch) & (F.col("false_refusals") <= false)).alias("met"))


def joint_scorecard(rows: DataFrame) -> DataFrame:
    """One row over mode, verdict, truth, debatable: wrongly answered, caught, missed, and fixed (answered before, refused now), headline rows only."""
    clear = rows.where(~F.coalesce(F.col("debatable"), F.lit(False)))
    answered, refuse, out = F.col("mode") == "answered", F.col("verdict") == "refuse", F.col("truth") == "out"
    return clear.agg(F.count(F.lit(1)).alias("n"), count_if(answered & out).alias("wrongly_answered"), count_if(refuse & out).alias("caught"), count_if(~refuse & out).alias("missed"), count_if(answered & refuse & out).alias("fixed"), count_if(refuse & ~out).alias("false_refusals"))


def attribution_totals(attributed: DataFrame) -> DataFrame:
    """One row over statuses: spans, attributed, unverifiable, wrong, and their causes."""
    found = F.col("source_id").isNotNull()
    return attributed.agg(F.count(F.lit(1)).alias("spans"), count_if(F.col("cid").isNotNull()).alias("attributed"), count_if(~found).alias("unverified"), count_if(found & (F.col("status") == "misattributed")).alias("misattributed"), count_if(F.col("status") == "unattributed").alias("without_id"), count_if(F.col("status") == "unknown").alias("unknown_id"))


def unintended_flips(flips: DataFrame, intended: DataFrame) -> DataFrame:
    """The rows of :func:`verdict_flips` whose id is not on the list of intended ones (id)."""
    return flips.join(intended.select("id").distinct(), "id", "left_anti")


def control_run(answers: DataFrame, key: DataFrame, qid: str = "question_id") -> DataFrame:
    """One row over answers (mode, verified) and what was expected of them (expected_behavior, refusal_source): how a run without the gate does.

    A refusal counts strictly where it came from the expected mechanism, and else as any; questions without an expectation are left out.
    """
    mode, refuse = F.col("mode"), F.col("expected_behavior") == "refuse"
    wanted = F.coalesce(*[F.when(F.col("refusal_source") == k, v) for k, v in REFUSAL_MODES.items()])
    return answers.join(key, qid).agg(
        count_if(~refuse).alias("n_answer"), count_if(~refuse & (mode == "answered")).alias("answered"), count_if(refuse).alias("n_refuse"), count_if(refuse & (mode == wanted)).alias("refused_strict"),
        count_if(refuse & (mode != "answered")).alias("refused_any"), count_if(F.col("verified")).alias("verified"),
    )
