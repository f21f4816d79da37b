"""FTRL-proximal against a plain loop over dictionaries, and on held-out labels."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from attesta.llm.toxicity import ToxicityParams, evaluate, features, fit, ftrl, held_out, score, toxicity, training_rows

DATA = "/root/testdata/sf0.1"


def plain(rows, labels, p):
    z, n = {}, {}
    w = lambda j, l1, l2: 0.0 if abs(z.get(j, 0.0)) <= l1 else -(z[j] - math.copysign(l1, z[j])) / ((p.beta + math.sqrt(n[j])) / p.alpha + l2)
    rate = lambda j: (0.0, 0.0) if j == "bias" else (p.l1, p.l2)
    for _ in range(p.epochs):
        for x, y in zip(rows, labels):
            x = [*x, "bias"]
            ws = {j: w(j, *rate(j)) for j in x}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y
            for j in x:
                a = n.get(j, 0.0)
                z[j] = z.get(j, 0.0) + g - (math.sqrt(a + g * g) - math.sqrt(a)) / p.alpha * ws[j]
                n[j] = a + g * g
    return {j: w(j, *rate(j)) for j in z}


def test_ftrl():
    r = random.Random(1)
    rows, labels = [], []
    for _ in range(120):
        y = r.random() < 0.4
        rows.append(np.array(sorted({r.randrange(50) for _ in range(8)} | ({100 + r.randrange(3)} if y else set())), np.int64))
        labels.append(float(y))
    p = ToxicityParams(alpha=0.5, l1=1.0, epochs=3)
    w0, coords, weights = ftrl(rows, np.array(labels), p)
    want = plain([x.tolist() for x in rows], labels, p)
    assert w0 == pytest.approx(want.pop("bias"), abs=1e-9)
    assert dict(zip(coords.tolist(), weights.tolist())) == pytest.approx({j: v for j, v in want.items() if v}, abs=1e-9)
    assert 0 < len(coords) < len(want)


def test_features_of_pairs_and_gaps():
    def own(text, bits=30):
        b = np.frombuffer(text.encode(), np.uint8)
        return set(features(b, np.array([0, len(b)]), bits)[1].tolist())

    a, b, c = own("a"), own("b"), own("c")
    assert len(own("a b")) == 3 and own("a b") - a - b != own("b a") - a - b
    assert len(own("a b c")) == 6 and own("a  B,c!") == own("a b c")
    # the pair of a and c with one word between them stays, whatever the word is
    gap = own("a b c") - own("a b") - own("b c") - c
    assert len(gap) == 1 and gap < own("a x c")
    assert own("") == set() and own(" .,") == set()
    two = np.frombuffer(b"a bc d", np.uint8)
    text, _ = features(two, np.array([0, 3, 6]), 20)
    assert sorted(text.tolist()) == [0, 0, 0, 1, 1, 1]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        toxic = r.random() < 0.3
        text = [r.choice(words) for _ in range(r.randrange(5, 60))]
        if toxic:
            text[r.randrange(len(text))] = r.choice(["vile", "RANCID"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs += [(None, "vile"), (5000, None), (5001, ""), (5002, "w1 " * 100_000 + "vile"), (3, docs[3][1])]
    labels += [(None, 1), (7, None), (9, labels[9][1])]
    schema = "doc_id long, text string"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores(spark, tables):
    docs, labels = tables
    out = toxicity(docs.selectExpr("text", "doc_id", "'x' AS score", "1 AS y", "2 AS key"), labels).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id is not null and toxic is not null").collect()}
    judged = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    own = {r.doc_id: r for r in out}
    assert own[5000].score == own[5001].score < 0.5 and own[5002].predicted == 1 and own[None].predicted == 1
    assert len({r.score for r in out if r.doc_id == 3}) == 1


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    m = fit(docs, labels)
    other = labels.withColumn("toxic", (held_out("doc_id") | (labels.toxic == 1)).cast("int"))
    m2 = fit(docs, other)
    assert m.intercept == m2.intercept and (m.coords == m2.coords).all() and (m.weights == m2.weights).all()
    assert sorted(r.score for r in score(docs, m).collect()) == sorted(r.score for r in score(docs.repartition(7), m).collect())


def test_bound_of_training_rows(spark, tables):
    docs, labels = tables
    few = training_rows(docs, labels, ToxicityParams(per_class=40)).groupBy("y").count().collect()
    assert {r.y for r in few} == {0, 1} and all(15 < r["count"] < 80 for r in few)
    assert training_rows(docs, labels).where("text is null").count() == 0


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert toxicity(docs.limit(0), labels).count() == 0
    out = toxicity(docs, labels.limit(0)).collect()
    assert len(out) == docs.count() and {r.score for r in out} == {0.0}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    r = evaluate(toxicity(docs, labels), labels).where("held_out").first()
    assert r.true_positive >= 0.8 * r.toxic and r.false_positive <= 0.005 * r.n and r.log_loss < 0.08
