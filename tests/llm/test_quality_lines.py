import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.llm import lines, quality

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words int"  # n_words clashes with a result column


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", 7) for i, t in enumerate(texts)], SCHEMA)


def base(text):
    w = WS.findall(text or "")
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, cover = Counter(win), set()
    for i, x in enumerate(win):
        if often[x] > 1:
            cover.update(range(i, i + 5))
    ls = [x for x in (text or "").split("\n") if WS.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_counts_are_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", " ", "\x00 a\u00a0b", "#$% <a>|", "a b c d e a b c d e", "x\n\nx\n \nx", "😀 " * 30]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "dd\t", "# "]) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["w%d " % (i % 7) * 3 for i in range(5)] + ["long words " * 20000]
    df = frame(spark, texts)
    got = {x.doc_id: x for x in quality.measured(df).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(t), t[:40] if t else t


def corpus(n=300):
    r = random.Random(9)
    vocab = [f"word{i}" for i in range(60)]
    good = [" ".join(r.choice(vocab) for _ in range(80)) for _ in range(n)]
    bad = [" ".join(f"{r.randint(0, 10**6)}!!" for _ in range(80)) for _ in range(n // 4)]
    return good, bad


def test_junk_goes_and_clean_documents_stay(spark):
    good, bad = corpus()
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(len(good), 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality.quality_rules(docs, labels).collect()}
    assert all(got[i] for i in range(len(good))) and not any(got[i] for i in range(len(good), len(good) + len(bad)))


def test_verdicts_are_brute_force(spark):
    """The model from counters over Spark's own bucket numbers, the score by the docstring's formula."""
    good, bad = corpus(60)
    texts = good + bad + [None, "", "few words"] + [g + " odd thing" for g in good[:9]]
    p = quality.QualityParams(buckets=512, held_out=3)
    docs = frame(spark, texts)
    rows = [(i, 1, 0) for i in range(0, 60, 2)] + [(1, 0, 0), (3, 1, 1), (len(good), 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    of = lambda w: quality.let(w, lambda x: quality.let(quality.hashes(x), lambda h: quality.ngram_buckets(x, h, p)))
    buckets = {x.doc_id: x.b for x in docs.select("doc_id", of(quality.words(F.col("text"))).alias("b")).collect()}
    held = {x.doc_id: x.h for x in labels.select("doc_id", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0).alias("h")).collect()}
    trusted = [d for d, q, t in rows if q == 1 and t == 0]
    raw, target = Counter(), Counter()
    for d, b in buckets.items():
        raw.update(b)
        if d in trusted and not held[d]:
            target.update(b)
    r_all, t_all = sum(raw.values()) + 512, sum(target.values()) + 512
    weight = [math.log((target[k] + 1) / t_all) - math.log((raw[k] + 1) / r_all) for k in range(512)]
    score = {d: sum(weight[k] for k in b) / (len(b) + p.prior_length) for d, b in buckets.items() if b}
    known = sorted(score[d] for d in trusted if held[d])
    at = p.reject_share * (len(known) - 1)
    low = known[int(at)] + (at - int(at)) * (known[min(int(at) + 1, len(known) - 1)] - known[int(at)])
    between = any(low - p.margin <= score[d] < low for d, q, t in rows if (q == 0 or t == 1) and held[d])
    edge = low if between else low - p.margin
    got = {x.doc_id: x for x in quality.quality_rules(docs, labels, p).collect()}
    for i, t in enumerate(texts):
        failed = base(t)[-1]
        assert got[i].llr is None if failed else abs(got[i].llr - score[i]) < 1e-3
        assert got[i].kept == (not failed and score[i] >= edge) or abs(score[i] - edge) < 1e-3
    assert not got[len(good)].kept


def test_every_label_counts(spark):
    """Documents beyond the 20,000 of the smallest hash are trusted like the others, so their words are no rarer in the target than in the corpus."""
    order = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    docs = spark.range(21_000).select(F.col("id").alias("doc_id")).withColumn("r", order).select("doc_id", F.when(F.col("r") > 20_000, F.repeat(F.lit("late words "), 6)).otherwise(F.repeat(F.lit("early word "), 6)).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(docs, labels)
    assert all(abs(w) < 1 for w in model.weights)


def test_no_labels_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, ["a b c d e f g h i j k", "x"])
    assert {x.doc_id: x.kept for x in quality.quality_rules(docs, labels).collect()} == {0: True, 1: False}
    assert quality.quality_rules(docs.where("false"), labels).count() == 0


def brute_lines(rows, p):
    """Written from the docstring: every count is a number of different texts."""
    split = lambda s: tuple(x for x in re.split(r"[ \t\n\x0b\f\r]", s) if x)
    mask = lambda s: split(re.sub(r"[^ \t\n\x0b\f\r]*[0-9@][^ \t\n\x0b\f\r]*", "<*>", s))
    order = lambda d: d if d is not None else -(2**63)
    lines_ = [(order(d), i, split(x), mask(x), t) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if split(x)]
    leaf = lambda t: (len(t), t[: p.depth])
    in_leaf, with_token, exact, with_template = (defaultdict(set) for _ in range(4))
    for _, _, raw, t, text in lines_:
        exact[raw if len(t) < p.min_tokens else t].add(text)
        if len(t) >= p.min_tokens:
            in_leaf[leaf(t)].add(text)
            for k, w in enumerate(t):
                with_token[leaf(t), k, w].add(text)

    def template(t):
        return tuple(w if w != "<*>" and len(with_token[leaf(t), k, w]) >= p.min_docs else "<*>" for k, w in enumerate(t))

    for _, _, _, t, text in lines_:
        if len(t) >= p.min_tokens:
            with_template[leaf(t), template(t)].add(text)

    def recurs(raw, t):
        if len(t) < p.min_tokens:
            return raw if len(exact[raw]) >= p.min_docs else None
        g = template(t)
        if len(with_template[leaf(t), g]) >= p.min_docs and sum(w != "<*>" for w in g) >= p.constant_share * len(g):
            return leaf(t), g
        return t if len(t) >= p.long_tokens and len(exact[t]) >= p.long_docs else None

    first, gone = {}, defaultdict(set)
    for d, i, raw, t, _ in sorted(lines_, key=lambda x: x[:2]):
        g = recurs(raw, t)
        if g and (first.setdefault(g, (d, i)) != (d, i) or not p.keep_first):
            gone[d].add(i)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[order(d)]) for d, t in rows}


@pytest.mark.parametrize("keep_first", [True, False])
def test_templates_are_brute_force(spark, keep_first):
    r = random.Random(1)
    p = lines.LineParams(min_docs=4, long_tokens=9, keep_first=keep_first)
    body = lambda: " ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) + str(r.choice(["", "", 1])) for _ in range(r.randint(1, 8)))
    long_ = [" ".join(r.choice("one two three four five".split()) for _ in range(9)) for _ in range(12)]
    rows = [(i, "\n".join([body() for _ in range(3)] + [f"Copyright by the firm {r.choice(['A', 'B', 'C', 'D', 'E'])} in {r.randint(1990, 2020)} all rights", ""][: r.randint(0, 2)] + r.sample(long_, r.randint(0, 1)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, rows[0][1]), (None, "Copyright by the firm A in 1999 all rights")]
    rows += [(105, "\n".join(f"The capital of {x} is {x}ville" for x in "abcdefghij")), (106, "\n".join(["some words of it here"] * 9))]
    df = spark.createDataFrame([(d, t, 5, 1) for d, t in rows], "doc_id long, text string, n_chars long, key int")
    got = {x.doc_id: x for x in lines.line_dedup(df, p).collect()}
    assert {d: x.text for d, x in got.items()} == brute_lines(rows, p) and any(x.n_dropped for x in got.values())
    assert got[0].key == 1 and got[105].n_dropped == got[106].n_dropped == 0
    assert (got[None].text == rows[64 + 1][1]) == keep_first
    assert all(x.n_chars == (len(x.text) if x.n_dropped else 5) for x in got.values())


def test_one_document_keeps_its_alike_lines_and_ten_lose_theirs(spark):
    alike = lambda k, n: "\n".join(f"The capital of place{chr(97 + i // 26)}{chr(97 + i % 26)} is town{k}" for i in range(n))
    df = spark.createDataFrame([(0, alike("x", 50)), (1, "other words stand here")], "doc_id long, text string")
    assert {x.n_dropped for x in lines.line_dedup(df).collect()} == {0}
    df = spark.createDataFrame([(i, f"{chr(97 + i) * 3} {chr(98 + i) * 2} {chr(99 + i) * 4} {chr(97 + i) * 5}\nAll content on this site is free\nYes.") for i in range(10)], "doc_id long, text string")
    assert [x.n_dropped for x in lines.line_dedup(df).orderBy("doc_id").collect()] == [0] + [2] * 9


def test_a_long_passage_recurs_in_two_documents(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(51))
    df = spark.createDataFrame([(3, f"one\n{passage}"), (4, f"two\n{passage}"), (5, f"three\n{passage[:60]}"), (6, f"four\n{passage[:60]}")], "doc_id long, text string")
    assert [x.text for x in lines.line_dedup(df).orderBy("doc_id").collect()] == [f"one\n{passage}", "two", f"three\n{passage[:60]}", f"four\n{passage[:60]}"]


def test_lines_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_dedup(df).count() == 0


@pytest.mark.parametrize("copies", [30])
def test_equal_documents_count_once(spark, copies):
    df = spark.createDataFrame([(i, "this very line stands here\nand this one too") for i in range(copies)], "doc_id long, text string")
    assert {x.n_dropped for x in lines.line_dedup(df).collect()} == {0}


def test_very_long_lines_and_very_many_dropped_lines(spark):
    """What a row costs grows with its tokens and lines, not with their square."""
    r = random.Random(9)
    word = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    base = [word(r.randrange(5000)) for _ in range(20_000)]
    near = [" ".join([*base[:100], f"own{word(k)}", *base[101:]]) for k in range(12)]
    many = "\n".join(f"common words of line {i} here" for i in range(50_000))
    rows = [(i, f"head {i}\n{t}") for i, t in enumerate(near)] + [(100 + i, f"{many}\nown line of document {i} alone") for i in range(3)]
    p = lines.LineParams(min_docs=2, long_tokens=10**9)
    start = time.time()
    got = {x.doc_id: x for x in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), p).select("doc_id", "n_dropped", F.length("text").alias("n")).collect()}
    assert time.time() - start < 120  # with the square of either it took many minutes
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 for i in range(1, 12))
    assert got[100].n_dropped == 49_999 and all(got[i].n_dropped == 50_001 and got[i].n == 0 for i in (101, 102))


def test_labelled_texts_meet_their_labels_by_shuffle(spark):
    """However few labels there are: what is shuffled follows the input from the smallest on."""
    docs = frame(spark, ["a b c", "d e f"])
    found = quality.labelled(docs, docs.where("doc_id = 1").select("doc_id"))
    assert [tuple(r) for r in found.collect()] == [(1, "d e f")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
