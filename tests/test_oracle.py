"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os
import re

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(x):
        if x is None or type(x).__name__ in ("NAType", "NaTType") or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, float) else x

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _names():
    from attesta.plans import queries as base

    return sorted(base.ORACLES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    from attesta.plans import queries as base

    got, want = base.QUERIES[name](spark, DATA).toPandas(), duck.execute(base.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_pages_are_accounted_for(spark):
    from attesta.plans import queries as base

    states = {r.state for r in base.QUERIES["page_disposition"](spark, DATA).collect()}
    assert "emitted" in states and "unaccounted" not in states
    assert base.QUERIES["page_blocks"](spark, DATA).where("kind = 'heading'").count() > 0


def test_results_do_not_depend_on_partitions(spark):
    from attesta.plans import queries as base

    first = rows(base.QUERIES["rrf_fusion"](spark, DATA).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(base.QUERIES["rrf_fusion"](spark, DATA).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["context_pack", "hybrid_retrieve", "citation_correct"])
def test_few_rows_go_to_the_documents(spark, name):
    """The rows that a search found are the side that is broadcast; documents are neither broadcast nor shuffled to them."""
    from attesta.plans import queries as base

    plan = base.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[id#\d+L\], \[id#\d+L\], Inner, BuildLeft", plan)
