"""The two-way order check: planted moves, losses and repeats, and random edits against a plain word-by-word telling."""

import collections
import itertools
import random

import pytest

from attesta.operators.order import increasing, order_runs


def plain(source, corpus, n):
    """Classes of one document's source words: lists of word lists."""
    a, b = [w for x in source for w in x], [w for x in corpus for w in x]
    grams = lambda w: [tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(1, len(w))))]
    ga, gb = grams(a), grams(b)
    where = collections.defaultdict(list)
    for j, g in enumerate(gb):
        where[g].append(j)
    seen, match = collections.Counter(), {}
    for i, g in enumerate(ga):
        if seen[g] < len(where[g]):
            match[i] = where[g][seen[g]]
        seen[g] += 1
    runs = []
    for i, j in sorted(match.items()):
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    chains = [c for k in range(len(runs) + 1) for c in itertools.combinations(range(len(runs)), k) if all(runs[x][1] < runs[y][1] for x, y in zip(c, c[1:]))]
    best = max(sum(runs[x][2] for x in c) for c in chains)
    chain = min(c for c in chains if sum(runs[x][2] for x in c) == best)
    label = [(3, None)] * len(a)
    for k, (i, j, s) in enumerate(runs):
        for p in range(i, min(len(a), i + s + n - 1)):
            label[p] = min(label[p], (0, 0) if k in chain else (1, j + p - i), key=lambda x: x[0])
    for i, g in enumerate(ga):
        if i not in match and where[g]:
            for p in range(i, min(len(a), i + n)):
                label[p] = min(label[p], (2, None), key=lambda x: x[0])
    starts = set(itertools.accumulate((len(x) for x in source), initial=0))
    out = []
    for p, (c, to) in enumerate(label):
        if c == 0:
            continue
        if out and out[-1][0] == c and out[-1][1] + out[-1][2] == p and (to is None or out[-1][3] + out[-1][2] == to):
            out[-1][2] += 1
        else:
            out.append([c, p, 1, to])
    name = lambda c, p, s: ("", "SPLICE", "REPEAT", "ABSENT" if p in starts and p + s in starts else "DROPOUT")[c]
    return {(name(c, p, s), p, s, to) for c, p, s, to in out}


def frames(spark, docs):
    rows = lambda k: [(d, i, " ".join(b)) for d, x in docs.items() for i, b in enumerate(x[k])]
    schema = "doc long, pos long, text string"
    return spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema)


def told(spark, docs, n=4):
    out = collections.defaultdict(set)
    for r in order_runs(*frames(spark, docs), "doc", "pos", "text", n).collect():
        out[r.doc, r.direction].add((r["class"], r.start, r.words, r.to))
    return out


def test_planted(spark):
    block = lambda a, k=12: [f"w{a}x{i}" for i in range(k)]
    b = [block(i) for i in range(8)]
    docs = {
        1: (b, b),
        2: (b, [b[0], b[5], *b[1:5], *b[6:]]),  # block 5 has moved
        3: (b, [*b[:3], *b[4:]]),  # block 3 is lost
        4: (b, [*b[:3], b[3][:5] + b[3][9:], *b[4:]]),  # four words of block 3 are lost
        5: ([*b, b[2]], b),  # block 2 comes twice here and once there
        6: (b, [[*b[0], *b[1]], *[b[2][:4], b[2][4:]], *b[3:]]),  # other blocks, same words
        7: (b, []),
        None: ([["too", "short"]], [["too", "short"]]),
    }
    got = told(spark, docs)
    s, c = "source -> corpus", "corpus -> source"
    assert got[1, s] == got[1, c] == got[6, s] == got[6, c] == got[None, s] == set()
    assert got[2, s] == {("SPLICE", 60, 12, 12)} and got[2, c] == {("SPLICE", 12, 12, 60)}
    assert got[3, s] == {("ABSENT", 36, 12, None)} and got[3, c] == set()
    assert got[4, s] == {("DROPOUT", 41, 4, None)}
    assert got[5, s] == {("REPEAT", 96, 12, None)} and got[5, c] == set()
    assert got[7, s] == {("ABSENT", 0, 96, None)} and got[7, c] == set()


@pytest.mark.parametrize("n", [2, 4])
def test_random_edits(spark, n):
    r = random.Random(n)
    docs = {}
    for d in range(30):
        source = [[r.choice("abcdefghijklmnop") if r.random() < 0.3 else f"{d}w{r.randrange(80)}" for _ in range(r.randrange(0, 9))] for _ in range(r.randrange(1, 7))]
        corpus = [list(x) for x in source]
        for _ in range(r.randrange(4)):
            k = r.randrange(len(corpus))
            match r.randrange(5):
                case 0:
                    corpus.insert(r.randrange(len(corpus)), corpus.pop(k))
                case 1 if len(corpus) > 1:
                    corpus.pop(k)
                case 2:
                    corpus.insert(k, list(r.choice(source)))
                case 3:
                    corpus[k][2:4] = []
                case _:
                    corpus[k] += ["new", "words"]
        docs[d] = (source, corpus)
    got = told(spark, docs, n)
    for d, (a, b) in docs.items():
        assert got[d, "source -> corpus"] == plain(a, b, n), d
        assert got[d, "corpus -> source"] == plain(b, a, n), d


def test_matched_once_and_long_documents(spark, monkeypatch):
    """Both directions read one table of matches, and documents beyond ``long`` words give the rows that shorter ones give."""
    from attesta.operators import order

    r, names = random.Random(5), []
    monkeypatch.setattr(order, "written", lambda df, name, f=order.written: names.append(name) or f(df, name))
    docs = {}
    for d in (*range(6), None):
        source = [[r.choice("abc") if r.random() < 0.6 else f"w{r.randrange(9)}" for _ in range(6)] for _ in range(2 + 2 * (d or 0))]
        corpus = [list(x) for x in source if r.random() < 0.8]
        r.shuffle(corpus)
        docs[d] = (source, corpus + source[:1])
    rows = lambda long: sorted((tuple(x) for x in order_runs(*frames(spark, docs), "doc", "pos", "text", 2, long=long).collect()), key=repr)
    plainly = rows(1 << 20)
    assert names.count("met") == 1 and "ranked" not in names
    assert rows(60) == rows(0) == plainly and "ranked" in names


def test_increasing_runs():
    r = random.Random(0)
    for _ in range(400):
        runs = [(i, j, r.randrange(1, 4)) for i, j in enumerate(r.sample(range(20), r.randrange(9)))]
        chains = [c for k in range(len(runs) + 1) for c in itertools.combinations(range(len(runs)), k) if all(runs[x][1] < runs[y][1] for x, y in zip(c, c[1:]))]
        weight = lambda c: sum(runs[x][2] for x in c)
        best = min(c for c in chains if weight(c) == max(map(weight, chains)))
        assert [i for i, f in enumerate(increasing(runs)) if f] == list(best)


def test_one_long_document(spark):
    """A hundred thousand words in one document, every tenth block lost: runs, not words, come together."""
    b = [[f"t{(i * 40 + k) * 7919 % 100_003}" for k in range(40)] for i in range(2500)]
    got = told(spark, {1: (b, [x for i, x in enumerate(b) if i % 10 != 4])})
    assert got[1, "source -> corpus"] == {("ABSENT", i * 40, 40, None) for i in range(4, 2500, 10)} and got[1, "corpus -> source"] == set()


def test_nothing(spark):
    assert told(spark, {}) == {} and told(spark, {1: ([[]], [])}) == {}
