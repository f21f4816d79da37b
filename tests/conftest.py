import os
import sys
from contextlib import contextmanager

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@contextmanager
def broadcast_rows(spark):
    """Holds at its end how many rows each broadcast of the block had."""
    store, bus, sent = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus(), []
    bus.waitUntilEmpty(30_000)
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    yield sent
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList()
    for x in {runs.apply(i).executionId() for i in range(runs.size())} - before:
        values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            if n.name() == "BroadcastExchange":
                found = [m for m in (n.metrics().apply(i) for i in range(n.metrics().size())) if m.name() == "number of output rows"]
                sent += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in found if values.contains(m.accumulatorId())]
