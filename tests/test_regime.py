import pytest
from pyspark.sql import functions as F

from attesta.operators import regime


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("GDPR", "gdpr"), ("GDPR", "general data protection regulation"), ("AI Act", "ai act")], "instrument string, alias string")


@pytest.mark.parametrize(
    "reply, hits, verdict",
    [
        ("GENERAL.", [], "pass"),
        ("General Data Protection Regulation", ["GDPR"], "pass"),  # a longer name that holds the sentinel's word
        ("UK GDPR", [], "refuse"),  # a qualified name is another instrument
        ("the AI Act; Data Act", ["AI Act"], "pass"),  # any of several is enough
        ("General Data Protection Regulation (GDPR)", ["GDPR"], "pass"),
        ("GDPR (General Data Protection Regulation); AI Act.", ["AI Act", "GDPR"], "pass"),
        ("", [], "refuse"),
    ],
)
def test_segments(spark, aliases, reply, hits, verdict):
    r = spark.createDataFrame([(1, reply)], "reply_id long, reply string")
    row = regime.declared(r, aliases).join(r, "reply_id").withColumn("v", regime.verdict(F.col("declared"), F.col("reply"))).first()
    assert row.declared == hits and row.v == verdict


def test_substring_matcher_is_looser(spark, aliases):
    r = spark.createDataFrame([(1, "UK GDPR"), (2, "xgdpr")], "reply_id long, reply string")
    assert {x.reply_id: x.declared for x in regime.declared_by_substring(r, aliases).collect()} == {1: ["GDPR"], 2: []}


def test_a_missing_alias_fails(spark, aliases):
    known = spark.createDataFrame([("GDPR",), ("NIS2",)], "instrument string")
    assert [r.instrument for r in regime.missing_aliases(known, aliases).collect()] == ["NIS2"]
    with pytest.raises(Exception, match="no alias for NIS2"):
        regime.require_total(known, aliases).collect()


def test_refusal_is_near_the_start(spark):
    t = "The provided sources do not answer this question."
    df = spark.createDataFrame([(f"Sorry. {t.upper()}",), ("x" * 60 + t,)], "t string").select(regime.is_refusal(F.col("t")).alias("r"))
    assert [r.r for r in df.collect()] == [True, False]
