import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import substrings as S


def brute(rows, n=200):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocab = ["ab", "cé", "d", " ", "ef\n", "xyz"]
    text = lambda a, b: "".join(r.choice(vocab) for _ in range(r.randint(a, b)))
    passages = [text(80, 500) for _ in range(8)]
    out = [(i, "".join(r.choice(passages)[r.randint(0, 40) :] if r.random() < 0.4 else text(1, 200) for _ in range(r.randint(0, 5)))) for i in range(150)]
    return out + [(1000, None), (1001, ""), (1002, "Le " * 400), (1003, "Le " * 60), (1004, passages[0]), (1004, passages[0]), (None, passages[1] * 2), (1005, "x" * 199), (1006, "y" * 201)]


@pytest.mark.parametrize("crowd, mapped", [(1024, S.MAPPED), (3, S.MAPPED), (1024, 0), (3, 0)])
def test_brute_force(spark, rows, crowd, mapped):
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, k string")
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in S.remove_repeats(df, crowd=crowd, mapped=mapped).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_common_prefixes():
    r = random.Random(1)
    for _ in range(20):
        segs = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 12))]
        size = np.array([len(s) for s in segs])
        starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        text, ends = np.frombuffer(b"".join(segs), np.uint8), np.repeat(starts + size, size)
        sa = S.suffix_array(text, ends, 200)
        suffix = [bytes(text[i : ends[i]]) for i in sa]
        assert suffix == sorted(suffix)
        lcp = S.common_prefixes(text, starts, sa, ends, 20)
        for a, b, i in zip(suffix, suffix[1:], sa[1:]):
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[i] == min(n, 20)


def test_merging_two_shards():
    one, two = b"q" + b"abc" * 100, b"abc" * 90 + b"z"
    flags, _ = S.repeated_in_shard([one], [False], 200)
    _, other = S.repeated_in_shard([two], [False], 200)
    flags[0][:] = False
    S.merge([one], flags, other, 200)
    assert flags[0].tolist() == [one[i : i + 200] in two for i in range(len(one) - 199)]


def test_long_texts_are_cut_in_overlapping_parts():
    x = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    assert np.array_equal(S.sliding_argmin(x, 137), np.array([i + int(np.argmin(x[i : i + 137])) for i in range(5000 - 136)]))


def test_segments_that_share_more_than_256_bytes():
    r = random.Random(11)
    draw = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    for _ in range(150):
        shared = draw(r.randint(257, 335))
        segs = [shared + b"b", shared + b"a", *(draw(336) for _ in range(6))]
        segs[:2] = [s + draw(336 - len(s)) for s in segs[:2]]
        count = Counter(s[i : i + 200] for s in segs for i in range(len(s) - 199))
        flags, _ = S.repeated_in_shard(segs, [False] * len(segs), 200)
        assert [f.tolist() for f in flags] == [[count[s[i : i + 200]] > 1 for i in range(len(s) - 199)] for s in segs]


def test_a_periodic_text_makes_few_segments(spark):
    rows = [(1, "-" * 30_000), (2, "ab" * 5_000 + "end"), (3, "x" + "-" * 250), (4, "abc" * 70 + "no"), (5, "ab" * 110)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in S.remove_repeats(df).collect()), key=repr)
    assert got == brute(rows)
    keyed = S._keyed(df)
    often = S._anchor_counts(keyed, 200, 64).where("c >= 2").select("fp")
    assert S._segments_by_map(keyed, often, often.count(), 200, 64).agg(F.sum(F.length("seg"))).first()[0] < 10 * sum(len(t) for _, t in rows) / 100
