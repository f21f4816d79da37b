"""Model calls as a stage of their own: batches of distinct prompts, a model loaded once a worker, and a ledger of what has been answered.

The ledger is a table keyed by model and prompt hash.  A stage asks for the distinct prompts that it lacks, ``batch`` of them in one call and
one call in a task by default: a task's replies are stored when the task commits, before the job ends, so a lost
executor or a failed job repeats only the calls that were under way.  Running the stage again asks for nothing that is in the ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Prompts in one call, calls in one task, prompts in one job.
BATCH, CALLS, JOB = 16, 1, 100_000

_LOADED: dict[str, Callable[[list[str]], list]] = {}


def _model(name: str, load: Callable[[], Callable[[list[str]], list]]) -> Callable[[list[str]], list]:
    """The worker's own model of this name, loaded at its first call."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def _key(model: str, prompt: str = "prompt"):
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.col(prompt)), 256)


def ledger_schema(reply: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("reply", reply)])


def read_ledger(spark: SparkSession, ledger: str, model: str, reply: T.DataType) -> DataFrame:
    """(key, reply): what is stored so far, a key once."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{model}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ledger_schema(reply))
    rows = spark.read.schema(ledger_schema(reply)).parquet(f"{ledger}/{model}")
    return rows.groupBy("key").agg(F.min("reply").alias("reply"))


def replies(
    df: DataFrame, prompt: str, model: str, load: Callable[[], Callable[[list[str]], list]], ledger: str, reply: T.DataType = T.StringType(), *, name: str = "reply", width: int | None = None,
    batch: int = BATCH, calls: int = CALLS, job: int = JOB,
) -> DataFrame:
    """``df`` with ``name``: the model's reply to ``prompt``; null prompts get none.  The calls are made when this is called.

    load: makes the model, a function from a list of prompts to as many replies.  width: how many numbers a reply must have, for
    embeddings.  A model that gives another number of replies, or one of another width, fails the job; nothing of that call is stored.
    """
    spark = df.sparkSession
    asked = df.select(F.col(prompt).alias("prompt")).where("prompt is not null").distinct().withColumn("key", _key(model))
    open_ = asked.join(read_ledger(spark, ledger, model, reply), "key", "left_anti")
    n = open_.count()
    arrow = to_arrow_type(reply)

    def call(batches) -> Iterator:
        import pyarrow as pa

        ask = _model(model, load)
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                got = ask(part.column("prompt").to_pylist())
                if len(got) != part.num_rows:
                    raise ValueError(f"{model} gave {len(got)} replies to {part.num_rows} prompts")
                if width is not None and any(g is None or len(g) != width for g in got):
                    raise ValueError(f"{model} gave a reply that is not {width} wide")
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(got, arrow)], names=["key", "reply"])

    while n > 0:
        # the smallest keys first: a job has a bounded number of calls, and what it stores is no longer open afterwards
        some = open_ if n <= job else open_.orderBy("key").limit(job)
        tasks = -(-min(n, job) // (batch * calls))
        dealt = some.select("key", "prompt").repartitionByRange(tasks, "key")
        # a task's file is moved to the table when the task commits, not when the job does
        writer = dealt.mapInArrow(call, ledger_schema(reply)).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.parquet(f"{ledger}/{model}")
        left = asked.join(read_ledger(spark, ledger, model, reply), "key", "left_anti")
        open_, n = left, left.count() if n > job else 0
    known = read_ledger(spark, ledger, model, reply).withColumnsRenamed({"key": "__key", "reply": name})
    return df.withColumn("__k", _key(model, prompt)).join(known, (F.col("__k") == F.col("__key")) & F.col(prompt).isNotNull(), "left").drop("__k", "__key")
