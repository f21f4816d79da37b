"""The prefix trie against plain dictionaries; the slot table against its keys."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from attesta.llm.trie import SlotTable, accumulate, prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    nodes = collections.defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in nodes if n)
    saved, leaves = collections.Counter(), collections.Counter()
    for n, m in nodes.items():
        s = (len(m) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += s
            leaves[n[:d]] += kids[n] == 0
    sha = lambda n, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(n)))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(n, m)) for n, m in nodes.items()), key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("text", "role", "turn", "conv_id", "'x' AS place", "1 AS depth").repartition(3)
    return sorted((tuple(r) for r in prefix_trie(df, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(4)
    rows = []
    for c in [*range(-12, 60), *range(1000, 1040), 10**15 + 3]:
        shared = r.random() < 0.6
        for t in range(r.choice([0, 1, 2, 5, 9, 12])):
            text = f"common {t}" if shared and t < 4 else r.choice(["yes", "no", "é" * 5, "", None])
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "user", None, "bot"]) if not shared else "user", text))
    rows += [(None, 0, "user", "of no conversation"), rows[5], rows[5]]
    rows += [(2000 + i, t, "u", f"copy {t}") for i in range(50) for t in range(3)]  # a group of copies
    return rows


@pytest.mark.parametrize("limit", [256, 8, 0])
def test_trie(spark, talks, limit):
    assert got(spark, talks, limit=limit) == brute(talks)


def test_one_very_long_conversation(spark):
    rows = [(7, t, "u", f"turn {t % 3}") for t in range(300)] + [(5, t, "u", f"turn {t % 3}") for t in range(20)] + [(c, 0, "u", "turn 0") for c in range(100, 130)]
    assert got(spark, rows, limit=16) == brute(rows)


def test_turnless_and_empty(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "u", "x")]) == []
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)  # without a base and shorter than its share
    assert got(spark, [(c, 0, "u", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute([(c, 0, "u", "gone")])


def test_slots():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        hi, lo = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 3, n, dtype=np.uint64) * np.uint64(7)
        t = SlotTable(hi, lo)
        assert sorted(t.slots(hi, lo).tolist()) == list(range(n))
        assert (t.slots(hi + np.uint64(1), lo) == -1).all() and (t.slots(hi, lo + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        SlotTable(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_accumulate_deepest_first():
    # 1 - (2 - (3, 4), 5): digests are their numbers, the parent of 1 lies elsewhere
    u = lambda *x: np.array(x, np.uint64)
    i = lambda *x: np.array(x, np.int64)
    z = np.zeros(5, np.uint64)
    kids, leaves, saved, parent, inner = accumulate(u(4, 2, 1, 5, 3), z, u(2, 1, 9, 1, 2), z, i(7, 6, 5, 6, 7), i(44, 22, 11, 55, 33), i(2, 3, 5, 1, 1), i(10, 100, 1000, 5, 7))
    assert kids.tolist() == [0, 2, 2, 0, 0] and leaves.tolist() == [1, 2, 3, 1, 1]
    assert saved.tolist() == [10, 210, 4210, 0, 0]
    assert inner.tolist() == [True, True, False, True, True] and parent[inner].tolist() == [22, 11, 11, 22]
