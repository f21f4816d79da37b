"""Model calls through a ledger: one call a distinct prompt, over failures and repetitions too."""

import collections
import os

import pytest
from pyspark.sql import types as T

from attesta.functions.calls import read_ledger, replies


def counting(folder, die_at=None):
    """A model that notes each prompt it answers in a file of its own process, and dies at one prompt until told otherwise."""

    def load():
        def ask(prompts):
            if die_at in prompts and os.path.exists(f"{folder}/die"):
                raise RuntimeError("lost")
            assert len(prompts) <= 4
            with open(f"{folder}/{os.getpid()}.txt", "a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            return [p.upper() for p in prompts]

        return ask

    return load


def called(folder):
    return collections.Counter(line for f in os.listdir(folder) if f.endswith(".txt") for line in open(f"{folder}/{f}").read().split())


def test_one_call_a_prompt(spark, tmp_path):
    folder, ledger = str(tmp_path), str(tmp_path / "ledger")
    prompts = [f"p{i % 60}" for i in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string").repartition(5)
    (tmp_path / "die").touch()
    ask = lambda: replies(df, "prompt", "count-1", counting(folder, "p7"), ledger, batch=4)
    with pytest.raises(Exception, match="lost"):
        ask()
    before = called(folder)
    stored = read_ledger(spark, ledger, "count-1", T.StringType()).count()
    (tmp_path / "die").unlink()
    out = ask()
    assert {r.id: r.reply for r in out.collect()} == {i: p and p.upper() for i, p in enumerate(prompts)}
    got = called(folder)
    assert set(got) == {f"p{i}" for i in range(60)} and "p7" not in before
    # what tasks had stored before the failure was not asked again; a call under way may have been
    assert stored > 0 and sum(got.values()) - 60 <= sum(before.values()) - stored
    assert {r.reply for r in ask().collect()} == {f"P{i}" for i in range(60)} | {None} and called(folder) == got
    # another model asks anew; jobs of few prompts store all the same
    assert replies(df, "prompt", "count-2", counting(folder), ledger, batch=4, job=13).where("reply is not null").count() == 300
    assert all(n >= 2 for n in called(folder).values())


def test_widths_and_numbers_of_replies(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "prompt string")
    vector = T.ArrayType(T.FloatType())
    fixed = lambda w: lambda: lambda prompts: [[1.0] * w for _ in prompts]
    ok = replies(df, "prompt", "w3", fixed(3), str(tmp_path / "l"), vector, name="embedding", width=3)
    assert sorted((r.prompt or "", r.embedding) for r in ok.collect()) == [("", None), ("a", [1.0] * 3), ("b", [1.0] * 3)]
    with pytest.raises(Exception, match="not 3 wide"):
        replies(df, "prompt", "w2", fixed(2), str(tmp_path / "l"), vector, width=3)
    with pytest.raises(Exception, match="1 replies to 2 prompts|0 replies to 1 prompts"):
        replies(df, "prompt", "few", lambda: lambda prompts: prompts[1:], str(tmp_path / "l"))
    assert read_ledger(spark, str(tmp_path / "l"), "w2", vector).count() == 0
    assert replies(df.where("false"), "prompt", "none", fixed(1), str(tmp_path / "l"), vector).count() == 0
