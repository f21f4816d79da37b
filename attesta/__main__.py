"""``python -m attesta ask QUESTION --corpus PATH``: answers from a corpus of chunks in Parquet; exit code 1 if a check fails."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="attesta")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ask", "show"):
        c = sub.add_parser(name)
        c.add_argument("question")
        c.add_argument("--corpus", required=True)
        c.add_argument("--floor", type=float, default=0.59)
        c.add_argument("--k", type=int, default=20)
        c.add_argument("--keep", type=int, default=5)
    a = p.parse_args(argv)
    from .plans.session import RagSession

    spark = SparkSession.builder.getOrCreate()
    session = RagSession(spark, spark.read.parquet(a.corpus), floor=a.floor, k=a.k, keep=a.keep)
    asked = spark.createDataFrame([(1, a.question)], "question_id long, question string")
    if a.command == "show":
        session.retrieve(asked).show(a.keep, truncate=100)
        return 0
    row = session.answer(asked).first()
    print(f"{row.mode}\n{row.answer or ''}")
    return int(not row.verified)


if __name__ == "__main__":
    sys.exit(main())
