"""Mechanical checks of answers: every quoted span stands in a retrieved chunk, and in the chunk that the answer cites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKER, MIN_SPAN, base_id, cited_ids, needle, normalize, outer_span, quote_pairs, segments, tokens
from ..sources.scratch import written
from . import lexical
from .events import asof


def answer_segments(answers: DataFrame, qid: str = "question_id", text: str = "answer") -> DataFrame:
    """(question_id, seg_no, segment): the lines of each folded answer."""
    return answers.select(F.col(qid).alias("question_id"), F.posexplode(segments(text)).alias("seg_no", "segment"))


def normalized_sources(sources: DataFrame, body: str = "body", compose: bool = True) -> DataFrame:
    """``sources`` with body_norm, so that each body is normalised once."""
    return sources.withColumn("body_norm", normalize(body, compose))


def first_source(spans: DataFrame, sources: DataFrame, compose: bool = True) -> DataFrame:
    """``spans`` (question_id, span, ...) with source_id: the first source in rank order whose normalised body holds the normalised span.

    sources: question_id, rank, id, body_norm; joined on question_id, so containment is tested within a question's few sources.
    An empty needle matches nothing.
    """
    asked = spans.select("question_id", "span").distinct().withColumn("needle", needle("span", compose))
    hit = asked.where("needle <> ''").join(sources.select("question_id", "rank", "id", "body_norm"), "question_id").where(F.contains("body_norm", "needle"))
    first = hit.groupBy("question_id", "span").agg(F.min_by("id", "rank").alias("source_id"))
    return spans.join(first, ["question_id", "span"], "left")


def read_segments(answers: DataFrame, sources: DataFrame, qid: str = "question_id", text: str = "answer", compose: bool = True) -> DataFrame:
    """(question_id, seg_no, pos, span, source_id, reading): the spans that count as quotes.

    A segment whose outermost span is short has none; one whose outermost span is found has that one; otherwise its pairs count if
    it has any, each with its own hit, and else the outermost span without a source.
    """
    seg = answer_segments(answers, qid, text).withColumn("outer", outer_span("segment")).where(F.length("outer") >= MIN_SPAN)
    seg = seg.withColumn("pairs", quote_pairs("segment"))
    outer = seg.select("question_id", "seg_no", "pairs", F.col("outer").alias("span"))
    outer = first_source(outer, sources, compose)
    whole = outer.where(F.col("source_id").isNotNull() | (F.size("pairs") == 0)).select("question_id", "seg_no", F.lit(0).alias("pos"), "span", "source_id", F.lit("outer").alias("reading"))
    split = outer.where(F.col("source_id").isNull()).select("question_id", "seg_no", F.posexplode("pairs").alias("pos", "span"))
    split = first_source(split, sources, compose).select("question_id", "seg_no", "pos", "span", "source_id", F.lit("pair").alias("reading"))
    return whole.unionByName(split)


def classify_ids(answers: DataFrame, sources: DataFrame, qid: str = "question_id", text: str = "answer") -> DataFrame:
    """(question_id, pos, cid, class, base): cited ids as known, refined (a known id and a parenthesis) or unknown, with the retrieved id they resolve to."""
    cited = answers.select(F.col(qid).alias("question_id"), F.posexplode(cited_ids(text)).alias("pos", "cid"))
    known = sources.select("question_id", "rank", "id")
    near = cited.join(known, "question_id").where((F.col("cid") == F.col("id")) | F.startswith("cid", F.concat("id", F.lit("("))))
    base = near.groupBy("question_id", "cid").agg(F.min_by("id", F.struct((F.col("cid") != F.col("id")).alias("x"), F.col("rank"))).alias("base"))
    out = cited.join(base, ["question_id", "cid"], "left")
    return out.select("question_id", "pos", "cid", F.when(F.col("base").isNull(), "unknown").when(F.col("base") == F.col("cid"), "known").otherwise("refined").alias("class"), "base")


def attribution(answers: DataFrame, quotes: DataFrame, sources: DataFrame, qid: str = "question_id", text: str = "answer", compose: bool = True) -> DataFrame:
    """``quotes`` (of :func:`read_segments`) with the cited id, its base and ``status``.

    The cited id is that of the nearest marker that begins at or after the span's first occurrence ends, in the same segment (an
    as-of join forward).  Status: unattributed (no marker), unknown (no retrieved base; reported elsewhere), ok (the base's body
    holds the span) or misattributed.
    """
    seg = answer_segments(answers, qid, text)
    marks = seg.select("question_id", "seg_no", "segment", F.regexp_extract_all("segment", F.lit(MARKER), F.lit(0)).alias("m"), F.split("segment", MARKER, -1).alias("gaps"))
    # a marker begins after all gaps and markers before it
    at = lambda i: F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("m", 1, i), F.lit(0), lambda s, x: s + F.length(x))
    marks = marks.where(F.size("m") > 0).select("question_id", "seg_no", F.explode(F.transform("m", lambda x, i: F.struct(at(i).alias("mpos"), F.substring(x, F.lit(2), F.length(x) - 2).alias("cid")))).alias("k")).select("question_id", "seg_no", "k.mpos", "k.cid")
    placed = quotes.join(seg, ["question_id", "seg_no"]).withColumn("ends", F.instr(F.col("segment"), F.col("span")) - 1 + F.length("span")).drop("segment")
    key = ["question_id", "seg_no", "pos", "span"]
    nearest = asof(placed, marks, ["question_id", "seg_no"], "ends", "mpos", ["cid"], forward=True).drop("ends")
    base = classify_ids(answers, sources, qid, text).select("question_id", "cid", "base")
    named = nearest.join(base, ["question_id", "cid"], "left")
    body = sources.select("question_id", F.col("id").alias("base"), F.col("body_norm").alias("base_body"))
    held = named.join(body, ["question_id", "base"], "left").withColumn("held", F.contains("base_body", needle("span", compose)))
    status = F.when(F.col("cid").isNull(), "unattributed").when(F.col("base").isNull(), "unknown").when(F.col("held"), "ok").otherwise("misattributed")
    return held.select(*key, "source_id", "reading", "cid", "base", status.alias("status"))


def misattributed(attributed: DataFrame) -> DataFrame:
    """(question_id, span, cited, actual): accepted spans that the cited chunk lacks; of equal spans the last counts."""
    last = attributed.where("source_id is not null").groupBy("question_id", "span").agg(F.max_by(F.struct("cid", "source_id", "status"), F.struct("seg_no", "pos")).alias("x"))
    return last.where("x.status = 'misattributed'").select("question_id", "span", F.col("x.cid").alias("cited"), F.col("x.source_id").alias("actual"))


def verified(answers: DataFrame, quotes: DataFrame, ids: DataFrame, wrong: DataFrame, qid: str = "question_id") -> DataFrame:
    """(question_id, n_quotes, n_missed, n_unknown, n_wrong, verified): no unknown id, no misattribution, every quote found."""
    q = quotes.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.sum(F.col("source_id").isNull().cast("long")).alias("n_missed"))
    i = ids.groupBy("question_id").agg(F.sum((F.col("class") == "unknown").cast("long")).alias("n_unknown"))
    w = wrong.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_wrong"))
    all_ = answers.select(F.col(qid).alias("question_id")).join(q, "question_id", "left").join(i, "question_id", "left").join(w, "question_id", "left").na.fill(0)
    return all_.withColumn("verified", (F.col("n_missed") == 0) & (F.col("n_unknown") == 0) & (F.col("n_wrong") == 0))


def base_matches(cid, anchors) -> F.Column:
    """A cited id equals one of the ``|``-separated anchors or refines it."""
    return F.exists(F.split(anchors, r"\|"), lambda a: (cid == a) | F.startswith(cid, F.concat(a, F.lit("("))))


#: Spans that a pass over the documents may test inside the row: as anchors, and as whole short spans.
ANCHORS, SHORT = 10_000, 1_000


def _short_spans(d: DataFrame, short: DataFrame) -> DataFrame | None:
    """(span_id, id) for spans that have no anchor: a stated set, in blocks of ``SHORT``, tested inside each document's row."""
    out, block = None, []

    def found(block) -> DataFrame:
        known = F.array(*[F.struct(F.lit(i).alias("span_id"), F.lit(n).alias("needle")) for i, n in block])
        return d.select("id", F.explode(F.filter(known, lambda x: F.contains("t", x["needle"]))).alias("x")).select("x.span_id", "id")

    for r in short.select("span_id", "needle").toLocalIterator():
        block.append((r.span_id, r.needle))
        if len(block) == SHORT:
            out, block = found(block) if out is None else out.unionByName(found(block)), []
    if block:
        out = found(block) if out is None else out.unionByName(found(block))
    return out


def corpus_containment(spans: DataFrame, docs: DataFrame, sid: str = "span_id", span: str = "span", cid: str = "id", text: str = "text", compose: bool = True) -> DataFrame:
    """(span_id, id): which documents hold which spans, normalised, over the whole corpus.

    The four whole words after a span's first are its anchor.  Up to ``ANCHORS`` anchors are looked up inside each document's row, so
    that only a document that has one meets the spans; more are met by an equi-join on the words' hash.  Containment is
    then tested for those pairs alone.  A span of fewer than six words has no anchor and is tested against every document, as
    part of a stated set of spans, in blocks.  Counting the anchors and reading the short spans runs when the query is built.
    """
    s = spans.select(F.col(sid).alias("span_id"), needle(span, compose).alias("needle")).where("needle <> ''").distinct().withColumn("w", F.split("needle", " "))
    s = written(s, "needles")
    d = docs.select(F.col(cid).alias("id"), normalize(text, compose).alias("t"))
    gram = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3))
    anchored = s.where(F.size("w") >= 6).select("span_id", "needle", gram(F.col("w"), F.lit(1)).alias("g"))
    few = [r.g for r in anchored.select("g").distinct().limit(ANCHORS + 1).collect()]
    w = d.withColumn("w", F.split("t", " "))
    grams = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2), F.get("w", i + 3)))
    if len(few) <= ANCHORS:
        met = w.select("id", "t", F.explode(F.array_distinct(F.filter(grams, lambda g: g.isin(few)))).alias("g"))
        long_ = met.join(anchored, "g").where(F.contains("t", "needle")).select("span_id", "id")
    else:
        near = w.select("id", F.explode(F.array_distinct(grams)).alias("g")).join(anchored, "g").select("id", "span_id", "needle").distinct()
        long_ = near.join(d, "id").where(F.contains("t", "needle")).select("span_id", "id")
    short = _short_spans(d, s.where(F.size("w") < 6))
    return (long_ if short is None else long_.unionByName(short)).distinct()


def normalized_index(docs: DataFrame, cid: str = "id", text: str = "text", compose: bool = True) -> lexical.Index:
    """The stored index of the normalised documents, built where there is none yet."""
    d = docs.select(F.col(cid).alias("id"), F.col(text).alias("t"))
    return lexical.stored_index(d, text="t", prepare=lambda c: normalize(c, compose), tag=f"normalized-{compose}")


def indexed_containment(spans: DataFrame, docs: DataFrame, sid: str = "span_id", span: str = "span", cid: str = "id", text: str = "text", compose: bool = True) -> DataFrame:
    """The rows of :func:`corpus_containment`, from a stored index of the normalised documents.

    All words of a span but its first and last stand in a document that holds it, as whole words; the rarest of them name the few
    documents that are read and tested.  A span of fewer than three words names none and is tested as before.  The index is built
    where these documents have none yet.
    """
    s = written(spans.select(F.col(sid).alias("span_id"), needle(span, compose).alias("needle")).where("needle <> ''").distinct(), "needles")
    d = docs.select(F.col(cid).alias("id"), F.col(text).alias("t"))
    ix = normalized_index(docs, cid, text, compose)
    worded = s.withColumn("w", tokens("needle"))
    # several spans may share an id
    long_ = worded.where(F.size("w") >= 3).withColumn("q", F.xxhash64("span_id", "needle"))
    named = lexical.holding(ix, long_.select(F.col("q").alias("question_id"), F.explode(F.slice("w", F.lit(2), F.size("w") - 2)).alias("term")))
    met = written(named.join(long_.select(F.col("q").alias("question_id"), "span_id", "needle"), "question_id").select("id", "span_id", "needle"), "named")
    found = d.join(met, "id").where(F.contains(normalize("t", compose), F.col("needle"))).select("span_id", "id")
    short = _short_spans(d.withColumn("t", normalize("t", compose)), worded.where(F.size("w") < 3))
    return (found if short is None else found.unionByName(short)).distinct()
