import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from attesta.llm import packing, rans  # noqa: E402
from attesta.llm.tokens import TextEncoder, tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def plain():
    e = TextEncoder(tokenizer_path())
    return lambda t: e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_pieces_encode_like_the_whole(plain):
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", " \n", "\t", "'", "'s", "n't", "a", "Bc", "é", "1", "²", "_", "!", "-", "_!", "'re", "×", "ß", ".", ",", "\xa0", "\x1c", "Ⅳ", "ª", "<|endoftext|>", "漢", "😀", "word", " the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    e = TextEncoder(tokenizer_path(), max_pieces=500)
    for t, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(t), repr(t)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma,", "x."]) + str(r.randint(0, 99)) for _ in range(r.randint(0, 300)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "long text " * 9000), (None, "no id"), (7, rows[7][1])]


def frame(spark, docs):
    return spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, start int")


def test_packing_holds_every_id_once(spark, docs, plain):
    rows = packing.pack(frame(spark, docs), with_ids=True).collect()
    seqs, pieces = {}, {}
    for x in rows:
        assert len(x.ids) == 4 * x.length and zlib.crc32(x.ids) == x.ids_crc32
        seqs.setdefault(x.sequence_id, []).append(x)
        pieces.setdefault(x.doc_id, []).append(x)
    for s in seqs.values():
        s.sort(key=lambda x: x.offset)
        assert [x.offset for x in s] == np.cumsum([0] + [x.length for x in s[:-1]]).tolist()
        n = sum(x.length for x in s)
        assert n == 2048 or n & (n - 1) == 0
    for d, t in docs:
        if d == 7:  # stands twice
            assert sum(x.length for x in pieces[d]) == 2 * (len(plain(t)) + 1)
            continue
        p = sorted(pieces[d], key=lambda x: x.start)
        assert b"".join(x.ids for x in p) == np.array([*plain(t), 1], "<u4").tobytes() and {x.doc_tokens for x in p} == {len(plain(t)) + 1}
    assert packing.pack(frame(spark, docs).where("false")).count() == 0


def test_hilbert_curve_visits_neighbours():
    for bits, dims in ((3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert np.array_equal(np.sort(keys), np.arange(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_a_text_and_its_repetition_stand_together():
    import pyarrow as pa

    s = "the same sentence stands here again and again "
    p = packing.projections(pa.array([s * k for k in (1, 10, 100, 1000, 30_000)] + ["other words are in this one", "", None]))
    assert np.abs(p[1:5] - p[0]).max() < 0.1 and np.abs(p[5] - p[0]).max() > 0.1 and not p[6:].any()


def test_tasks_get_equal_shares():
    sizes = np.array([5, 0, 5, 400, 5, 5, 30, 30, 15, 5])
    first, number = packing.shares(sizes, 10)
    load = np.zeros(10)
    for f, n, s in zip(first, number, sizes):
        load[f : f + n] += s / n
    assert (np.diff(first) >= 0).all() and load.max() <= 2 * sizes.sum() / 10 and load.sum() == sizes.sum()
    assert (packing.shares(np.zeros(4, np.int64), 3)[0] == 0).all()


def test_neighbours_on_the_curve_are_alike(spark):
    """Over a real table, documents that follow each other share more trigrams than any two do."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    text = {x.doc_id: x.text or "" for x in rows}
    df = spark.createDataFrame([(d, t) for d, t in text.items()], "doc_id long, text string")
    order = [x.doc_id for x in sorted(packing.pack(df).where("start = 0").collect(), key=lambda x: (x.sequence_id, x.offset))]
    grams = {d: {t[i : i + 3] for i in range(len(t) - 2)} for d, t in text.items()}
    like = lambda a, b: len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b]))
    r = random.Random(5)
    near = np.mean([like(a, b) for a, b in zip(order, order[1:])])
    far = np.mean([like(*r.sample(order, 2)) for _ in range(2000)])
    assert near > 1.3 * far, (near, far)


def test_token_files_round_trip(spark, docs, plain, tmp_path):
    path = str(tmp_path / "tokens")
    rans.write_token_files(frame(spark, docs), path)
    rows = rans.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [x.doc_id for x in rows] == [d for d, _ in order]
    at = 0
    for x, (_, t) in zip(rows, order):
        ids = np.array([*plain(t), 2], "<u4").tobytes()
        assert (x.start, x.n_tokens, x.ids) == (at, len(ids) // 4, ids) and x.ids_crc32 == zlib.crc32(ids)
        at += x.n_tokens
    empty = str(tmp_path / "empty")
    rans.write_token_files(frame(spark, docs).where("false"), empty)
    assert rans.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, (1 << 18) + 5])
def test_images(n):
    r = np.random.default_rng(n)
    for ids in (np.minimum(r.geometric(0.01, n), 50256), np.full(n, 7), r.integers(0, 50257, n)):
        ids = ids.astype("<u4")
        data = rans.write_image([3, None], [n - 1, 1], ids)
        docs, lengths, out = rans.read_image(data)
        assert docs == [3, None] and lengths.tolist() == [n - 1, 1] and np.array_equal(out, ids)
    damaged = data[:-1] + bytes([data[-1] ^ 255])
    with pytest.raises(ValueError):
        rans.read_image(damaged)


def test_skewed_text_shrinks():
    ids = np.random.default_rng(0).geometric(0.05, 1 << 18).astype("<u4")
    assert len(rans.write_image([1], [len(ids)], ids)) < 0.25 * ids.nbytes


def test_added_tokens_encode_like_the_library():
    from tokenizers import Tokenizer

    texts = ["ends <|endoftext|> here", "<|endoftext|>", "a,<|endoftext|>b\nc <|endoftext|><|endoftext|> d", "long words " * 20 + "<|endoftext|>", "<|endoftext", "plain words, only"]
    library = Tokenizer.from_file(tokenizer_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in TextEncoder(tokenizer_path()).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [2412, 220, 50256, 994]
