"""The stored positional index against plain lists; stems and folding against published examples."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions.analyze import ENGLISH, PLAIN, STOP, Analyzer, fold_ascii, porter
from attesta.operators import lexical
from attesta.sources import chunks as C

from .conftest import broadcast_rows

# Examples of words and stems from the published description of the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil is is as as article15 article15 über über""".split()


def test_stems(spark):
    df = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2])), "w string, s string")
    assert df.select("w", "s", porter("w").alias("p")).where("p <> s").collect() == []


def test_folding(spark):
    words = [("Straße, Élan", "strasse, elan"), ("coöperate Ærø NAÏVE", "cooperate aero naive"), ("ét́ œuf łódź ẽ", "et oeuf lodz e"), ("日本 ж", "日本 ж"), (None, None)]
    assert [r.f for r in spark.createDataFrame(words, "t string, w string").select(fold_ascii("t").alias("f")).collect()] == [w for _, w in words]



@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    words = ["the", "Running", "runs", "article", "15", "annex", "of", "dog", "Élan", "elan", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(r.choice(words[: r.choice([8, 20, len(words)])]) for _ in range(r.randrange(1, 50)))) for i in range(160)]
    docs += [(200, None), (201, ""), (202, "article 15 of the annex " * 400), (203, "the the the"), (None, "dog"), (-5, "w1 w2. W3")]
    asked = [(1, "Article 15"), (2, "running of the dog"), (3, "w1 w2 w3"), (4, "the"), (5, "unknownword"), (6, None), (7, "dog dog dog"), (8, "w5 w6 article"), (9, "élan runs")]
    return docs, asked


def terms(text, a):
    text = text or ""
    if a.fold:
        text = text.replace("É", "e").replace("é", "e")
    stem = {"running": "run", "runs": "run", "article": "articl", "elan": "elan", "annex": "annex"}
    return [(i, stem.get(w, w) if a.stem else w) for i, w in enumerate(re.findall("[a-z0-9]+", text.lower())) if w not in a.stop]


def words_of(text, a):
    return len(re.findall("[a-z0-9]+", ((text or "").replace("É", "e").replace("é", "e") if a.fold else text or "").lower()))


def tables(spark, corpus):
    docs, asked = corpus
    return spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "question_id long, question string")


@pytest.mark.parametrize("a", [PLAIN, ENGLISH], ids=["plain", "english"])
@pytest.mark.parametrize("window", [512, 7])
def test_index(spark, corpus, tmp_path, a, window):
    docs, asked = corpus
    d, q = tables(spark, corpus)
    lexical.build_index(d, str(tmp_path / "ix"), analyzer=a, window=window)
    ix = lexical.read_index(spark, str(tmp_path / "ix"), a)
    docs = [x for x in docs if x[0] is not None]
    places = collections.defaultdict(list)
    for i, t in docs:
        for p, w in terms(t, a):
            places[w, i].append(p)
    assert {(r.term, r.id): r.places for r in lexical.positions(ix).collect()} == places
    assert {(r.term, r.df, r.cf) for r in ix.terms.collect()} == {(w, len(v), sum(v)) for w, v in ((w, [len(p) for (x, _), p in places.items() if x == w]) for w in {w for w, _ in places})}
    assert ix.n == len(docs) and ix.avgdl == pytest.approx(sum(words_of(t, a) for _, t in docs) / len(docs))
    # scores of all documents, by the formula
    want = {}
    for question, text in asked:
        scores = collections.Counter()
        for w in {w for _, w in terms(text, a)}:
            own = {i: len(p) for (x, i), p in places.items() if x == w}
            for i, tf in own.items():
                dl = words_of(dict(docs)[i], a)
                scores[i] += math.log(1 + (len(docs) - len(own) + 0.5) / (len(own) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / ix.avgdl))
        for r, (s, i) in enumerate(sorted((-round(s, 6), i) for i, s in scores.items())[:10]):
            want[question, r] = (i, pytest.approx(-s, abs=2e-6))
    got = {(r.question_id, r.lex_rank): (r.id, r.bm25) for r in lexical.search(ix, q, 10).collect()}
    assert {k: v[1] for k, v in want.items()} == {k: v[1] for k, v in got.items()}
    assert {k: v[0] for k, v in want.items()} == {k: v[0] for k, v in got.items()}
    # phrases and spans
    phrases, spans = {}, {}
    for question, text in asked:
        w = terms(text, a)
        for i, t in docs:
            there = dict(terms(t, a))
            at = [p - w[0][0] for p, x in there.items() if w and x == w[0][1] and all(there.get(p - w[0][0] + o) == y for o, y in w)]
            if at:
                phrases[question, i] = (len(at), min(at) + w[0][0])
            need, best = {x for _, x in w}, None
            if need and need <= set(there.values()):
                last = {}
                for p, x in sorted(there.items()):
                    if x in need:
                        last[x] = p
                        if len(last) == len(need):
                            best = min(best or 10**9, p - min(last.values()) + 1)
                spans[question, i] = best
    assert {(r.question_id, r.id): (r.times, r.first) for r in lexical.phrase_match(ix, q).collect()} == phrases and phrases
    assert {(r.question_id, r.id): r.span for r in lexical.near(ix, q).collect()} == spans and spans
    two = {k: v for k, v in spans.items() if v <= len({x for _, x in terms(dict(asked)[k[0]], a)}) + 2}
    assert {(r.question_id, r.id): r.span for r in lexical.near(ix, q, 2).collect()} == two


def test_identifier_questions_find_their_anchor(spark, corpus, tmp_path):
    """What a build's smoke test asks: the document that names an identifier is among the five best, with the English analyzer too."""
    d, _ = tables(spark, corpus)
    lexical.build_index(d, str(tmp_path / "ix"), analyzer=ENGLISH)
    ix = lexical.read_index(spark, str(tmp_path / "ix"), ENGLISH)
    q = spark.createDataFrame([(1, "What does Article 15 of the annex say?")], "question_id long, question string")
    hits = lexical.search(ix, q, 5)
    anchors = spark.createDataFrame([(1, 202)], "question_id long, anchor long")
    assert all(r.ok for r in C.smoke(d, d.count(), hits, anchors, hits).collect())


def test_a_stored_index_is_built_once_and_again_when_files_change(spark, corpus, tmp_path):
    d, q = tables(spark, corpus)
    path = str(tmp_path / "docs")
    d.write.parquet(path)
    first = lexical.stored_index(spark.read.parquet(path))
    assert lexical.stored_index(spark.read.parquet(path)).path == first.path
    assert lexical.stored_index(spark.read.parquet(path), analyzer=Analyzer(stop=STOP)).path != first.path
    d.limit(3).write.mode("append").parquet(path)
    second = lexical.stored_index(spark.read.parquet(path))
    assert second.path != first.path and second.n == first.n + d.limit(3).where("id is not null").count()
    plan = lexical.search(second, q)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "text" not in plan
    lexical.drop_index(first)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        lexical.read_index(spark, first.path)


def test_windows_below_the_floor_are_not_read(spark, tmp_path):
    """One window holds the ten best by far; the others' bounds lie below, so their postings are skipped."""
    docs = [(i, "rare rare rare rare") if i < 10 else (i, "rare " + "filler " * 500) for i in range(2000)]
    d = spark.createDataFrame(docs, "id long, text string")
    lexical.build_index(d, str(tmp_path / "ix"), window=20)
    ix = lexical.read_index(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "rare")], "question_id long, question string")
    best = lexical.search(ix, q, 10)
    assert sorted(r.id for r in best.collect()) == list(range(10))
    live = [p for p in best.inputFiles() if "/windows-" in p]
    assert live and spark.read.parquet(*live).count() <= 10 < ix.blocks.select("window").distinct().count()


def test_nothing_to_index(spark, tmp_path):
    d = spark.createDataFrame([], "id long, text string")
    lexical.build_index(d, str(tmp_path / "ix"))
    ix = lexical.read_index(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "a b")], "question_id long, question string")
    assert ix.n == 0 and lexical.search(ix, q).count() == 0 and lexical.phrase_match(ix, q).count() == 0 and lexical.near(ix, q).count() == 0
    assert lexical.positions(ix).select(F.size("places")).count() == 0


def test_windows_to_read_are_never_broadcast(spark, tmp_path):
    """What a search reads grows with the documents: it meets the blocks in their buckets, and a bucket holds few windows."""
    d = spark.createDataFrame([(i, "alpha beta" if i % 7 else "alpha gamma") for i in range(400)], "id long, text string")
    lexical.build_index(d, str(tmp_path / "ix"), window=4)
    ix = lexical.read_index(spark, str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix" / "stats")).first().buckets == 13
    q = spark.createDataFrame([(1, "alpha gamma")], "question_id long, question string")
    plan = lexical.search(ix, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("BroadcastHashJoin") == 1


def test_terms_of_all_documents_are_never_broadcast(spark, tmp_path):
    docs = spark.range(400).select("id", F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(5))).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    ix = lexical.stored_index(spark.read.parquet(str(tmp_path / "docs")))
    assert ix.terms.count() == 2000
    wanted = spark.createDataFrame([(1, "w1x7"), (1, "w2x7"), (2, "w1x8"), (2, "none")], "question_id long, term string")
    with broadcast_rows(spark) as sent:
        assert [tuple(r) for r in lexical.holding(ix, wanted).collect()] == [(1, 7)]
    assert sent and max(sent) <= 4


def test_rows_of_one_document_and_digests(spark, tmp_path):
    """Rows of one id and length are one document; digests run over ids in order, across windows."""
    import hashlib

    rows = [(i, f"w{i % 5} x w{i % 5}") for i in range(60)] + [(7, "x w2 x"), (8, None)]
    lexical.build_index(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "ix"), window=8)
    ix = lexical.read_index(spark, str(tmp_path / "ix"))
    places = {}
    for i, t in rows:
        for p, w in enumerate((t or "").split()):
            places.setdefault(w, {}).setdefault(i, []).append(p)
    want = {w: (len(v), hashlib.md5(";".join(f"{i}:{','.join(map(str, sorted(v[i])))}" for i in sorted(v)).encode()).hexdigest()) for w, v in places.items()}
    assert {r.term: (r.df, r.places_md5) for r in lexical.places_digest(ix).collect()} == want


def test_places_are_packed_and_digests_sort_text(spark, tmp_path):
    """A block's places are one binary value, and neither they nor a document's words are sorted as nested arrays."""
    d = spark.createDataFrame([(i, "b a b a a") for i in range(3)], "id long, text string")
    lexical.build_index(d, str(tmp_path / "ix"))
    ix = lexical.read_index(spark, str(tmp_path / "ix"))
    assert dict(ix.blocks.dtypes)["gaps"] == "binary" and {len(r.gaps) for r in ix.blocks.where("term = 'a'").collect()} == {3 * 3 * 4}
    assert "aggregate(" not in lexical.places_digest(ix)._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, tuple(r.places)) for r in lexical.positions(ix).where("term = 'a'").collect()} == {(i, (1, 3, 4)) for i in range(3)}
