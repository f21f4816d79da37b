"""Collocations against a plain count; the quotient filter against a dictionary."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm.collocations import PhraseParams, collocations, pack, unpack
from attesta.llm.quotient import QuotientFilter, filters, permute, restore, sort_and_sum

ASCII = {i: i + 32 for i in range(65, 91)}


def brute(rows, p):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, p.longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= p.least}
    over = collections.Counter()
    for (lang, g), c in candidates.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                over[lang, g[i : i + m]] = max(over[lang, g[i : i + m]], c)
    out = collections.defaultdict(list)
    for (lang, g), a in candidates.items():
        if not over[lang, g] or 100 * over[lang, g] < p.cover * a:
            s, _, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out[lang].append((-s, -a, " ".join(g).encode(), left, right))
    return sorted((lang, i + 1, ph.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, ph, x, y) in enumerate(sorted(v)[: p.top]))


def got(spark, rows, p):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    return sorted(tuple(r) for r in collocations(df.withColumnsRenamed({"doc_id": "word"}).repartition(3), p).collect())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = ["new", "york", "city", "the", "of", "a", "Été", "été", "x\xa0y", "\x00", "日本", "ÀB", "w" * 90, *(f"r{i}" for i in range(40))]
    texts = []
    for _ in range(300):
        words = []
        while len(words) < r.randrange(60):
            words += r.choice([["New", "York", "City"], ["out", "of", "the", "box"], ["a", "a", "a", "a", "a"], [r.choice(vocabulary)], [r.choice(vocabulary)]])
        texts.append("".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "?!", "\x0b"]) for w in words))
    rows = [(r.choice(["en", "en", "de", None, "und", ""]), t) for t in texts]
    return rows + [("en", None), (None, ""), ("xx", " \t.;"), *rows[:30], *[("hot", "same words here again")] * 200, ("long", "one two three " * 20_000)]


@pytest.mark.parametrize("p", [PhraseParams(), PhraseParams(least=3), PhraseParams(least=3, top=7), PhraseParams(least=2, head=5, word_bytes=6), PhraseParams(least=4, longest=2)], ids=str)
def test_collocations(spark, corpus, p):
    want = brute(corpus, p)
    assert want and got(spark, corpus, p) == want


def test_nothing_to_count(spark):
    assert got(spark, [], PhraseParams()) == []
    assert got(spark, [(None, None), ("en", "too few words")], PhraseParams()) == []


def test_scores_beyond_64_bits(spark):
    a = 2**62
    s = spark.sql(f"SELECT (CAST({a} AS DECIMAL(20, 0)) * 2000000) div (CAST({a} AS DECIMAL(20, 0)) + {a - 7}) AS s").first().s
    assert s == 2000000 * a // (a + a - 7)


@pytest.mark.parametrize("k,bits", [(2, 12), (3, 14), (4, 16), (3, 30), (4, 32), (2, 32)])
def test_filters_lose_nothing(k, bits):
    rng = np.random.default_rng(k * bits)
    half = k * bits // 2
    keys = [rng.integers(0, min(1 << bits, 60), 5000, dtype=np.uint64) + np.uint64((1 << bits) - 60) for _ in range(k)]
    packed = pack(keys, bits)
    assert all((a == b).all() for a, b in zip(unpack(*packed, k, bits), keys))
    left, right = permute(*packed, half)
    assert all((a == b).all() for a, b in zip(restore(left, right, half), packed))
    want = collections.Counter(zip(*(x.tolist() for x in keys)))
    for shard_bits in (1, 5):
        parts = [filters(*sort_and_sum(left[i::3], right[i::3], None, half), half, shard_bits) for i in range(3)]
        merged = {}
        for s, f in (x for p in parts for x in p):
            back = QuotientFilter.from_bytes(f.to_bytes())
            assert (back.left == f.left).all() and (back.right == f.right).all() and (back.counts == f.counts).all()
            merged.setdefault(s, []).append(back)
        read = {}
        for s, own in merged.items():
            f = QuotientFilter.merged(own)
            assert (f.count(f.left, f.right) == f.counts).all()
            ids = unpack(*restore(f.left | np.uint64(s << f.room), f.right, half), k, bits)
            read.update(zip(zip(*(x.tolist() for x in ids)), f.counts.tolist()))
        assert read == want


def test_counters_of_any_size():
    counts = np.array([1, 127, 128, 2**14, 2**35, 2**62], np.int64)
    f = QuotientFilter(np.arange(6, dtype=np.uint64), np.zeros(6, np.uint64), counts, 9, 10)
    assert (QuotientFilter.from_bytes(f.to_bytes()).counts == counts).all()


def test_bitmaps_mean_what_the_map_reads(spark):
    rows = spark.range(1, 70_000, 9_001).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("b")).first()
    assert {int(i) + 1 for i in np.flatnonzero(np.unpackbits(np.frombuffer(rows.b, np.uint8), bitorder="little"))} == {(i - 1) % 32768 + 1 for i in range(1, 70_000, 9_001)}
