import random
import re
from collections import Counter

import numpy as np
import pytest

from attesta.llm import jaccard

WS = re.compile(r"[^\x20\x09-\x0D]+")


def grams(t, n):
    w = WS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    sets, root, where = {d: grams(t, n) for d, t in rows}, {}, {}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        shared = Counter(e for g in s for e in where.get(g, ()))
        for e, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for g in s:
            where.setdefault(g, []).append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(n)] for n in (4, 5, 20, 60, 150)]
    out = []
    for i in range(260):
        w = list(r.choice(base + base[-1:] * 5))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((i, " ".join(w[: len(w) - r.choice([0, 0, 0, 3])])))
    return out + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A\tB"), (1004, "a b c"), (1005, " ")]


@pytest.mark.parametrize("n, percent, tile", [(4, 85, 256), (4, 85, 12), (3, 60, 25)])
def test_brute_force(spark, rows, n, percent, tile):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_join(df, n, percent, tile).collect()}
    assert got == brute(rows, n, percent)


def test_one_of_each_group_stays(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(0, rows[0][1], "x")], "doc_id long, text string, key string")
    left = [x.doc_id for x in jaccard.keep_first(df, 5, 80).collect()]
    assert sorted(left) == sorted({c for _, c in brute(rows, 5, 80).values()})
    assert jaccard.keep_first(df, 5, 80).columns == ["doc_id", "text", "key"]


def test_small_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "other words stand in this row")], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id) for x in jaccard.jaccard_join(df).collect())
    assert got == [(-1, 2, 3), (3, 2, 3), (3, 3, 3)]
    assert jaccard.jaccard_join(df.where("false")).count() == 0 and jaccard.keep_first(df.where("false")).count() == 0


def test_trie_is_brute_force():
    r = np.random.default_rng(8)
    for _ in range(60):
        sets = [np.unique(r.integers(0, 40, r.integers(1, 30))).astype(np.uint64) for _ in range(r.integers(2, 25))]
        percent = int(r.choice([50, 70, 85, 100]))
        k = len(sets)

        def components(links):
            root = list(range(k))
            for a, b in links:
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
            return root

        want = [(i, j) for i in range(k) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - both)]
        assert components(jaccard.connecting(jaccard.similar_pairs(sets, percent, [True] * k), k)) == components(want)


def test_trie_finds_each_pair_once():
    r = np.random.default_rng(9)
    for _ in range(60):
        sets = [np.unique(r.integers(0, 40, r.integers(1, 30))).astype(np.uint64) for _ in range(r.integers(2, 25))]
        percent, k = int(r.choice([50, 70, 85, 100])), len(sets)
        want = [(j, i) for i in range(k) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - both)]
        assert sorted(jaccard.similar_pairs(sets, percent, [True] * k)) == sorted(want)
        probes = (r.random(k) < 0.5).tolist()
        if not all(probes):
            assert sorted(tuple(sorted(p)) for p in jaccard.similar_pairs(sets, percent, probes)) == sorted(p for p in want if probes[p[0]] != probes[p[1]])


@pytest.mark.parametrize("tile", [256, 12])
def test_every_link_is_counted(spark, rows, tile):
    rows = [*rows, (2000, rows[0][1]), (2000, rows[0][1]), (None, rows[0][1])]
    sets = [grams(t, 4) for _, t in rows]
    like = lambda s, e: 100 * len(s & e) >= 85 * len(s | e)
    want = [(d, len(s), sum(bool(s) and like(s, e) for e in sets) - bool(s)) for (d, _), s in zip(rows, sets)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, tile)
    assert sorted(((x.doc_id, x.n_shingles, x.n_links) for x in got.collect()), key=repr) == sorted(want, key=repr)


def test_unlike_documents_of_null_or_equal_ids_all_stay(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(12))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("d"))]
    left = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(((x.doc_id, x.text) for x in left), key=repr) == sorted(rows[:-1], key=repr)


def test_a_block_of_20000_classes_is_dealt_in_bounded_groups(spark):
    r = np.random.default_rng(4)
    n = np.concatenate([r.integers(20, 2000, 14_000), np.full(6_000, 300), [10**6]])
    df = spark.createDataFrame([(i, x, 1, 7, "") for i, x in enumerate(n.tolist())], "cls long, n long, copies long, block long, text string")
    got = jaccard._tiles(df, 85, 256).toPandas()
    weight = np.maximum(n, jaccard.UNIT)
    per = got.assign(w=weight[got.cls.to_numpy()]).where(got.cls != len(n) - 1).groupby(["i", "j", "probe"]).w.sum()
    assert per.max() < 2.5 * 256 * jaccard.UNIT  # a task's group, whatever the block's size
    groups = got.groupby("cls").apply(lambda x: {(i, j): p for i, j, p in zip(x.i, x.j, x.probe)}, include_groups=False)
    for a, b in r.integers(0, len(n), (4000, 2)):
        if a != b and 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b]):
            assert sum(g[0] == g[1] or p != groups[b][g] for g, p in groups[a].items() if g in groups[b]) == 1


def test_sparse_sets_are_not_walked():
    sets = [np.arange(100 * i, 100 * i + 50, dtype=np.uint64) for i in range(400)] + [np.arange(49, dtype=np.uint64)]
    assert jaccard.similar_pairs(sets, 85, [True] * 401) == [(0, 400)]
