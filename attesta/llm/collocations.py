"""Phrases whose words keep company, counted in quotient filters.

Texts are cut into pieces and words; words that occur ``least`` times in their language get numbers, the most frequent first, by a range sort
whose stretches carry their counts over.  The ``head`` most frequent are broadcast (a fixed number of words of a bounded length) and
looked up exactly; the words beyond them are joined to their occurrences.  From then on the corpus is rows of
numbers, 0 where a piece ends or a rarer word stands: no candidate can reach over these.

N-grams are counted level by level.  A task packs the numbers of an n-gram into one key, permutes it, and keeps a counting quotient
filter (:mod:`attesta.llm.quotient`), which loses nothing of the key; every few million keys it sends its filters, one for each shard.
A shard's filters are merged as sorted runs, and keys that reach ``least`` are read back out.  From three words on an n-gram is counted only where both its
shorter parts may be frequent, by a bit map of a fixed size; bits that other phrases share cost work but change no result.

Scores are exact: products are decimals of 38 digits.  All steps after the counting are joins and range sorts of the frequent phrases.

Edge cases: a null text is empty, a null language is ``und``; repeated rows all count; a text without a word or an empty table adds nothing;
ties are settled by occurrences and then by the phrase; other input columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import in_order, running
from .bytewise import LOWER, batches_of_texts, mix
from .common import discard, owned, utf8, written
from .quotient import QuotientFilter, filters, permute, restore, sort_and_sum

BATCH_BYTES = 1 << 20
#: Keys that a task holds before it sends them, entries that a shard holds before it merges them, occurrences a shard stands for.
HELD, MERGED, SHARD = 1 << 21, 1 << 20, 1 << 18
#: Bits of the map that says which shorter phrases may be frequent: 16 MB.
MAP_BITS = 27

# What parts words, and what ends a piece.
BETWEEN, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BETWEEN)] = 1
_KIND[list(ENDS)] = 2


@dataclass(frozen=True)
class PhraseParams:
    """longest: words of a phrase; least: occurrences of a candidate; cover: percent of its occurrences inside a longer one that drop it; top: rows a language."""

    longest: int = 4
    least: int = 30
    cover: int = 80
    top: int = 2000
    head: int = 1 << 18
    word_bytes: int = 64


def cut(data: np.ndarray, starts: np.ndarray):
    """(words as an Arrow array, text of each, whether a piece begins with it)."""
    import pyarrow as pa

    kind = _KIND[data]
    inside = kind == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < len(data)]
    begin[edge] = inside[edge]
    first, at = np.flatnonzero(begin), np.flatnonzero(inside)
    offsets = np.append(np.searchsorted(at, first), len(at)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[at]]))
    text = np.searchsorted(starts, first, "right") - 1
    ended = np.cumsum(kind == 2)[first]
    new = np.ones(len(first), bool)
    new[1:] = (ended[1:] != ended[:-1]) | (text[1:] != text[:-1])
    return words, text, new


def _parts(batch, columns: list[str]):
    """(lang array, its numbers by text, what :func:`cut` gives, other columns) of the texts of a batch, a part at a time."""
    langs = batch.column("lang").dictionary_encode()
    data, starts = utf8(batch.column("text"))
    numbers = langs.indices.to_numpy()
    for lo, hi in batches_of_texts(starts, BATCH_BYTES):
        part = starts[lo : hi + 1]
        yield langs.dictionary, numbers[lo:hi], cut(data[part[0] : part[-1]], part - part[0]), [batch.column(c).slice(lo, hi - lo) for c in columns]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, c); a null word has all the words of a language."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for langs, number, (words, text, _), _ in _parts(batch, []):
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                n = len(coded.dictionary)
                own, c = np.unique(number[text].astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(own // n)), coded.dictionary.take(pa.array(own % n)), pa.array(c.astype(np.int64))], names=["lang", "word", "c"])
                own, c = np.unique(number[text], return_counts=True)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(own)), pa.nulls(len(own), pa.string()), pa.array(c.astype(np.int64))], names=["lang", "word", "c"])

    return docs.mapInArrow(work, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


class Head:
    """The numbers of the broadcast words, by language and word."""

    def __init__(self, langs: list[str], words: list[str], ids: list[int]):
        self.rows = langs, words, ids
        self.ready = False

    def __reduce__(self):
        return Head, self.rows

    def numbers(self, langs, number: np.ndarray, words, text: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for one that isn't here."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.ready:
            lang, word = pa.array(self.rows[0], pa.string()).dictionary_encode(), pa.array(self.rows[1], pa.string()).dictionary_encode()
            self.langs, self.words, self.n = lang.dictionary, word.dictionary, len(word.dictionary)
            key = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * self.n + word.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key)
            self.key, self.ids, self.ready = key[order], np.asarray(self.rows[2], np.int64)[order], True
        if not len(words) or not len(self.key):
            return np.zeros(len(words), np.int64)
        coded = words.dictionary_encode()
        word = pc.index_in(coded.dictionary, self.words).fill_null(-1).to_numpy()[coded.indices.to_numpy()].astype(np.int64)
        lang = pc.index_in(langs, self.langs).fill_null(-1).to_numpy()[number[text]].astype(np.int64)
        key = np.where((word >= 0) & (lang >= 0), lang * self.n + word, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.ids[at], 0)


def _beyond(docs: DataFrame, head, rest: DataFrame) -> DataFrame:
    """``docs`` with ``more``: (place, id) of the words that the head lacks and ``rest`` (lang, word, id) has.  Texts are known by 128 bits of hash here."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for langs, number, (words, text, _), (x, y) in _parts(batch, ["x", "y"]):
                known = head.value.numbers(langs, number, words, text)
                place = np.arange(len(words)) - np.searchsorted(text, np.arange(len(number)))[text]
                other = np.flatnonzero(known == 0)
                t = pa.array(text[other])
                yield pa.RecordBatch.from_arrays([x.take(t), y.take(t), langs.take(pa.array(number[text[other]])), words.take(pa.array(other)), pa.array(place[other].astype(np.int32))], names=["x", "y", "lang", "word", "place"])

    keyed = docs.withColumns({"x": F.xxhash64(F.lit(1), "lang", "text"), "y": F.xxhash64(F.lit(2), "lang", "text")})
    # written, so that the join splits a hot word's rows
    met = written(keyed.mapInArrow(work, "x long, y long, lang string, word string, place int"), "rarer").join(rest, ["lang", "word"])
    more = written(met.groupBy("x", "y").agg(F.sort_array(F.collect_set(F.struct("place", "id"))).alias("more")), "more")
    return keyed.join(more, ["x", "y"], "left")


def encoded(docs: DataFrame, head, beyond: bool) -> DataFrame:
    """(ids): the words' numbers as 32-bit integers, parted by 0 where a piece ends or a word has none."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for langs, number, (words, text, new), more in _parts(batch, ["more"] if beyond else []):
                ids = head.value.numbers(langs, number, words, text)
                if beyond:
                    base = np.searchsorted(text, np.arange(len(number)))
                    for t, pairs in enumerate(more[0].to_pylist()):
                        for p in pairs or ():
                            ids[base[t] + p["place"]] = p["id"]
                out = np.zeros(len(ids) + int(new.sum()) + 1, np.uint32)
                out[np.arange(len(ids)) + np.cumsum(new)] = ids
                keep = np.append(True, (out[1:] != 0) | (out[:-1] != 0))
                yield pa.RecordBatch.from_arrays([pa.array([out[keep].tobytes()], pa.binary())], names=["ids"])

    return docs.mapInArrow(work, "ids binary")


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A bit of the map for each ``k`` numbers in a row."""
    h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for i in range(k):
        h = mix(h + (ids[i : len(ids) - k + 1 + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return h >> np.uint64(64 - MAP_BITS)


def pack(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the packed key of numbers of ``bits`` (even) bits each."""
    b, h = np.uint64(bits), np.uint64(bits // 2)
    if len(columns) == 2:
        return columns[0], columns[1]
    if len(columns) == 3:
        return (columns[0] << h) | (columns[1] >> h), ((columns[1] & np.uint64((1 << bits // 2) - 1)) << b) | columns[2]
    return (columns[0] << b) | columns[1], (columns[2] << b) | columns[3]


def unpack(left: np.ndarray, right: np.ndarray, k: int, bits: int) -> list[np.ndarray]:
    b, h, m = np.uint64(bits), np.uint64(bits // 2), np.uint64((1 << bits) - 1)
    if k == 2:
        return [left, right]
    if k == 3:
        low = np.uint64((1 << bits // 2) - 1)
        return [left >> h, ((left & low) << h) | (right >> b), right & m]
    return [left >> b, left & m, right >> b, right & m]


def frequent(ids: DataFrame, k: int, bits: int, least: int, shard_bits: int, shorter) -> DataFrame:
    """(g, c, bit): the phrases of ``k`` numbers that occur ``least`` times.  shorter: a broadcast bit map of those of k - 1, or None."""
    half = k * bits // 2
    shard_bits = max(1, min(shard_bits, half - 1))

    def count(batches):
        import pyarrow as pa

        left, right, held = [], [], 0

        def sent():
            a, b, c = sort_and_sum(np.concatenate(left), np.concatenate(right), None, half)
            own = filters(a, b, c, half, shard_bits)
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.int64()), pa.array([f.to_bytes() for _, f in own], pa.binary())], names=["shard", "filter"])

        for batch in batches:
            for raw in batch.column("ids"):
                x = np.frombuffer(raw.as_buffer(), np.uint32)
                if len(x) < k:
                    continue
                full = np.ones(len(x) - k + 1, bool)
                for i in range(k):
                    full &= x[i : len(x) - k + 1 + i] != 0
                if shorter is not None:
                    at = gram_hashes(x, k - 1)
                    some = ((shorter.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    full &= some[:-1] & some[1:]
                at = np.flatnonzero(full)
                a, b = permute(*pack([x[at + i].astype(np.uint64) for i in range(k)], bits), half)
                left.append(a)
                right.append(b)
                held += len(at)
                if held >= HELD:
                    yield sent()
                    left, right, held = [], [], 0
        if held:
            yield sent()

    def merge(batches):
        import pyarrow as pa

        shard, own, held = None, [], 0

        def read():
            f = QuotientFilter.merged(own)
            some = f.counts >= least
            a = f.left[some] | np.uint64(shard << f.room)
            ids = unpack(*restore(a, f.right[some], half), k, bits)
            n = len(a)
            g = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.stack(ids, axis=1).ravel().astype(np.int64)))
            bit = gram_hashes(np.stack(ids, axis=1).ravel(), k)[::k] if n else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([g, pa.array(f.counts[some]), pa.array(bit.astype(np.int64))], names=["g", "c", "bit"])

        for batch in batches:
            for s, raw in zip(batch.column("shard").to_pylist(), batch.column("filter")):
                if s != shard:
                    if own:
                        yield read()
                    shard, own, held = s, [], 0
                own.append(QuotientFilter.from_bytes(raw.as_py()))
                held += len(own[-1])
                if held >= MERGED and len(own) > 1:
                    own = [QuotientFilter.merged(own)]
                    held = 0
        if own:
            yield read()

    dealt = ids.mapInArrow(count, "shard long, filter binary").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, "g array<long>, c long, bit long")


def bit_map(found: DataFrame):
    """The broadcast map of the phrases ``found``: 2**MAP_BITS bits at most, put together from Spark's bitmaps."""
    value = F.col("bit") + 1
    rows = found.groupBy(F.bitmap_bucket_number(value).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")).collect()
    out = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for r in rows:
        out[(r.n - 1) * 4096 : r.n * 4096] = np.frombuffer(r.bits, np.uint8)
    return found.sparkSession.sparkContext.broadcast(out)


def _counted(docs: DataFrame, p: PhraseParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, totals): phrases (g, c) of up to ``longest`` numbers, vocabulary (id, lang, word), totals (lang, n)."""
    counts = written(word_counts(docs).where((F.col("c") >= p.least) | F.col("word").isNull()), "words")
    totals = counts.where("word is null").select("lang", F.col("c").alias("n"))
    ordered = in_order(counts.where("word is not null"), [], [F.desc("c"), "lang", "word"])
    vocabulary = written(running(ordered, [], {"id": ("sum", F.lit(1).cast("long"))}).select("id", "lang", "word", "c"), "vocabulary")
    size = vocabulary.count()
    if size >= 1 << 32:
        raise ValueError("numbers of words have 32 bits")
    near = (F.col("id") <= p.head) & (F.octet_length("word") <= p.word_bytes)
    rows = vocabulary.where(near).toPandas()
    head = docs.sparkSession.sparkContext.broadcast(Head(rows.lang.tolist(), rows.word.tolist(), rows.id.tolist()))
    beyond = len(rows) < size
    source = _beyond(docs, head, vocabulary.where(~near).select("lang", "word", "id")) if beyond else docs
    ids = written(encoded(source, head, beyond), "numbers")
    bits = max(12, size.bit_length() + size.bit_length() % 2)
    n = totals.agg(F.sum("n")).first()[0] or 0
    shard_bits = max(6, (n // SHARD).bit_length())
    out, shorter = vocabulary.select(F.array("id").alias("g"), "c"), None
    for k in range(2, p.longest + 1):
        found = written(frequent(ids, k, bits, p.least, shard_bits, shorter), f"phrases-{k}")
        out = out.unionAll(found.select("g", "c"))
        if shorter is not None:
            shorter.unpersist()
        if k < p.longest:
            shorter = bit_map(found)
    discard(ids)
    return written(out, "phrases"), vocabulary, totals


def _scored(phrases: DataFrame, p: PhraseParams) -> DataFrame:
    """(g, a, l, r, score) of the candidates that no longer one covers."""
    candidates = phrases.where(F.size("g") >= 2).select("g", F.col("c").alias("a"))
    size = F.size("g")
    # both sides of each join are written, so that hot parts ("of the") are split
    cuts = F.explode(F.sequence(F.lit(1), size - 1)).alias("at")
    sides = candidates.select("g", "a", cuts).select("g", "a", "at", F.posexplode(F.array(F.slice("g", F.lit(1), F.col("at")), F.slice("g", F.col("at") + 1, size - F.col("at")))).alias("side", "part"))
    sides = written(sides, "sides").join(phrases.select(F.col("g").alias("part"), "c"), "part")
    each = sides.groupBy("g", "a", "at").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("r"))
    each = each.withColumn("score", F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + r)"))
    best = each.groupBy("g", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("x")).select("g", "a", "x.l", "x.r", "x.score")
    longer = candidates.where(size >= 3)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("g", i, n))))
    over = longer.select(F.explode(F.array_distinct(inner)).alias("g"), F.col("a").alias("most")).groupBy("g").agg(F.max("most").alias("most"))
    both = written(best, "scores").join(written(over, "covered"), "g", "left")
    kept = F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * p.cover)
    return both.where(kept).select("g", "a", "l", "r", "score")


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.  Counting runs when this is called."""
    if not 2 <= p.longest <= 4:
        raise ValueError("phrases have two to four words")
    with owned(docs.sparkSession):
        return written(_ranked(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), p), "collocations", own=False)


def _ranked(docs: DataFrame, p: PhraseParams) -> DataFrame:
    phrases, vocabulary, totals = _counted(docs, p)
    named = written(_scored(phrases, p), "scored").join(vocabulary.select(F.col("id").alias("__i"), "lang"), F.element_at("g", 1) == F.col("__i")).drop("__i")
    by = [F.desc("score"), F.desc("a")]
    one = {"rank": ("sum", F.lit(1).cast("long"))}
    numbered = written(running(in_order(named, ["lang"], by), ["lang"], one), "numbered")
    # words are fetched for the first ``top`` and what ties with the last of them
    last = numbered.where(F.col("rank") == p.top).select("lang", F.struct("score", "a").alias("floor"))
    first = numbered.join(last, "lang", "left").where(F.col("floor").isNull() | (F.struct("score", "a") >= F.col("floor"))).drop("rank", "place", "floor")
    first = written(first, "first")
    words = written(first.select("g", F.posexplode("g").alias("i", "id")), "spelled").join(vocabulary.select("id", "word"), "id")
    spelled = words.groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    final = running(in_order(first.join(spelled, "g"), ["lang"], [*by, "phrase"]), ["lang"], one).where(F.col("rank") <= p.top)
    return final.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in SQL: every n-gram is counted, without any filter or level.
ORACLE = r"""
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
words AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, g, count(*) AS c FROM (SELECT lang, w[i:i + k - 1] AS g FROM places) GROUP BY lang, g HAVING count(*) >= 30),
cand AS (SELECT lang, g, c AS a FROM f WHERE len(g) >= 2),
over_ AS (SELECT lang, g, max(a) AS most FROM (
  SELECT lang, a, g[i:i + k - 1] AS g FROM (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS k) WHERE k < len(g))) GROUP BY lang, g),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand),
scored AS (SELECT c.lang, c.g, c.a, c.k, l.c AS l, r.c AS r, CAST(2000000::HUGEINT * c.a // (l.c::HUGEINT + r.c) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS z FROM scored) WHERE z = 1),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN over_ o ON o.lang = b.lang AND o.g = b.g WHERE o.most IS NULL OR 100::HUGEINT * o.most < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000"""
