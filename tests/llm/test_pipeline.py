import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = [f"word{i}" for i in range(400)]
    text = lambda n: "\n".join(" ".join(r.choice(vocab) for _ in range(20)) for _ in range(n))
    rows = [(i, text(4)) for i in range(60)]
    item = " ".join(r.choice(vocab) for _ in range(30))
    rows += [(100, rows[0][1]), (101, rows[1][1] + " end"), (102, rows[2][1] + "\n" + item), (103, " ".join(f"{r.randint(0, 9**9)}%%" for _ in range(90))), (104, None), (105, "short")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        left[name] = {x.doc_id for x in docs.collect()}
    clean = set(range(60))
    assert left["quality rules"] == clean | {100, 101, 102}  # junk, null and short go
    assert left["line dedup"] == left["quality rules"]
    assert left["n-gram Jaccard join"] == clean | {102}
    assert left["benchmark decontamination"] == clean


def test_run_packs_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {x.doc_id for x in rows} == set(range(60))
    total = {x.doc_id: x.doc_tokens for x in rows}
    assert sum(x.length for x in rows) == sum(total.values())


def test_columns_of_any_name_come_out_unchanged(spark, folder):
    names = ["kept", "n_words", "items", "spans", "contaminated", "__key", "key", "n_hit", "llr", "__words", "n_lines", "__gone", "component", "a.b", "lang"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("lang")
    own = docs.select("doc_id", "text", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names], "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, folder)
        assert out.columns == own.columns
        rows = out.collect()
        assert len(rows) >= 60 and all(x[n] == f"{n} of {x.doc_id}" for x in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, own, folder).count() >= 60


def test_nulls_repeated_rows_long_texts_and_empty_tables(spark, folder):
    r = random.Random(12)
    text = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    a, b, long_ = text(40), text(50), text(60_000)
    docs = spark.createDataFrame([(None, a, 1), (None, b, 2), (None, None, 3), (5, None, 4), (6, "", 5), (7, long_, 6), (8, a, 7), (8, a, 7)], "doc_id long, text string, extra int")
    none = lambda d, i: sorted(((x.doc_id, (x.text or "")[:9], x.extra) for x in d.collect()), key=repr)
    every = none(docs, 0)
    left = {name: none(stage(spark, docs, folder), 1) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert left["quality rules"] == [x for x in every if len(x[1]) > 1]  # without a text there are too few words
    assert left["line dedup"] == left["benchmark decontamination"] == every
    assert left["n-gram Jaccard join"] == [x for x in every if x[0] != 8]  # of (null, a), (8, a) and (8, a) the first stays
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).where("doc_id = 7").count() > 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name


def test_run_leaves_only_its_last_input(spark, folder):
    from pathlib import Path

    from attesta.sources.scratch import shared_dir

    before = set(Path(shared_dir(spark)).iterdir())
    rows = corpus_pipeline.run(spark, folder).count()
    left = [x.name.rsplit("-", 1)[0] for x in set(Path(shared_dir(spark)).iterdir()) - before]
    assert rows and left == ["benchmark-decontamination"]
