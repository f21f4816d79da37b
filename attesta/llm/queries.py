"""The ``opN_<name>`` queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    r = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


@query
def op1_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query
def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op8_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .rans import read_token_files, write_token_files

    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


@query
def op2_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import mark

    r = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op7_trie_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85).drop("key", "component")


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    r = remove_repeats(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    r = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", F.array_join("license_sentences", ",").alias("license_sentences"), F.array_join("licenses", ",").alias("licenses"), "n_license_sentences")


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


@query
def op9_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op11_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query
def op12_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_perfect_hash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def _oracles() -> None:
    from . import collocations, licenses, trie

    ORACLES["op4_license_sentences"] = licenses.ORACLE
    ORACLES["op11_quotient_collocations"] = collocations.ORACLE
    ORACLES["op13_perfect_hash_trie"] = trie.ORACLE


_oracles()
