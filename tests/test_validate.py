"""Checks of numbered sequences."""

from attesta.operators import validate


def test_a_task_sorts_a_bounded_number_of_rows(spark):
    """Tasks are as many as the rows ask for, each group whole in one; a session's number of partitions sets no bound."""
    df = spark.range(1000).selectExpr("id div 10 as k", "id % 10 + 1 as n")
    dealt = validate._dealt(df, "k", rows=50)
    assert dealt.rdd.getNumPartitions() == 20
    assert validate._dealt(df.limit(0), "k").rdd.getNumPartitions() == 1
    assert validate.sequence_faults(df, "k", "n", "n").count() == 0
    found = validate.sequence_faults(df.where("n <> 4 or k <> 7"), "k", "n", "n").collect()
    assert [(r.k, r.label, r.fault) for r in found] == [(7, "5", "gap")]
