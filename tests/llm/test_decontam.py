import random
import re

import numpy as np
import pytest

from attesta.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    out = {}
    for d, t in docs:
        w, hit, its = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                if g in windows:
                    hit.update(range(k, k + size))
                    its |= windows[g]
        out[d] = (len(w), len(hit), sorted(its))
    return out


@pytest.fixture(scope="module")
def tables():
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "ÀB", "x1"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([3, 9, 10, 11, 30]))) for i in range(25)] + [(50, None), (51, ""), (52, "..."), (53, "unique"), (None, text(12))]
    items.append((60, items[3][1]))
    docs = []
    for i in range(150):
        t = text(r.randint(0, 60))
        if r.random() < 0.5:
            w = (items[r.randrange(25)][1]).upper().split()
            a = r.randrange(len(w))
            t += ", " + "; ".join(w[a:]) + ". " + text(r.randint(0, 5))
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "UNIQUE"), (203, docs[0][1] * 400), (None, items[0][1]), (204, docs[1][1]), (205, docs[1][1])]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_brute_force(spark, tables, block):
    docs, items = tables
    d = spark.createDataFrame([(*x, "v") for x in docs], "doc_id long, text string, spans string")  # spans clashes
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, sorted(x.items)) for x in decontam.mark(d, b, block_bytes=block).collect()}
    assert got == brute(docs, items)


def test_removal_keeps_columns_and_clean_documents(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n int")
    b = spark.createDataFrame(items, "item_id long, text string")
    left = decontam.decontaminate(d, b)
    want = {k for k, v in brute(docs, items).items() if not v[1]}
    assert left.columns == ["doc_id", "text", "n"] and {x.doc_id for x in left.collect()} == want
    assert decontam.decontaminate(d, b.where("false")).count() == len(docs)
    assert decontam.decontaminate(d.where("false"), b).count() == 0


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "x a b c d y"), (2, "b c d e f g")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    got = {x.item_word: (x.length, x.doc_id, x.doc_word) for x in decontam.longest_matches(d, b).collect()}
    assert got == {0: (4, 1, 1), 1: (5, 2, 0), 2: (4, 2, 1), 3: (3, 2, 2), 4: (2, 2, 3)}


def test_suffix_array_is_sorted():
    r = np.random.default_rng(3)
    seq = r.integers(0, 4, 300).astype(np.uint64)  # 0 ends a text
    seq[-1] = 0
    at = np.flatnonzero(seq[:-1])
    sa = decontam.suffix_array(seq, at.copy(), 50)

    def suffix(p):
        out = []
        while seq[p]:
            out.append(int(seq[p]))
            p += 1
        return out

    assert [suffix(p) for p in sa] == sorted(suffix(p) for p in at)


def test_long_items_are_cut_without_losing_a_window():
    r = random.Random(8)
    for n in (0, 1, 9, 10, 11, 25, 300):
        text = "; ".join(f"Ü{r.randint(0, 99)}" for _ in range(n))
        for most in (20, 50, 10**6):
            parts = [words(p) for p in decontam.cut(text, 10, most)]
            w = words(text)
            size = min(10, len(w))
            assert {tuple(p[i : i + size]) for p in parts for i in range(len(p) - size + 1)} == {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            assert all(len(" ".join(p).encode()) < most + 400 for p in parts)
