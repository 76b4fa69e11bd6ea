"""The running evaluation against the batch one, and calls that are asked once though a run dies."""

import os
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casequarry.operators import evaluate
from casequarry.operators.ledger import Ledger
from casequarry.streaming import running, shadow

SCHEMA = "seq long, revision long, predicted array<string>, truth array<string>"


def records(seed):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, [], [rng.choice("abcdefgh ") for _ in range(rng.randrange(6))]])
    return [(rng.randrange(40), rng.randrange(4), some(), some()) for _ in range(160)] + [(None, 1, ["a"], ["b"]), (3, None, ["a"], ["b"])]


def stated(spark, rows):
    """Rows of which no two share id and revision, and the newest of each id."""
    unique = {(r[0], r[1]): r for r in rows}
    newest = {r[0]: r for r in sorted((r for r in unique.values() if None not in r[:2]), key=lambda r: r[1])}
    return list(unique.values()), evaluate.differences(spark.createDataFrame(list(newest.values()), SCHEMA))


def follow(spark, folder):
    running.follow(shadow.read(spark, f"{folder}/log", SCHEMA, 2), f"{folder}/state", f"{folder}/checkpoint").awaitTermination()


def state(spark, folder):
    return [running.rates(spark, f"{folder}/state").first(), *(running.most_common(spark, f"{folder}/state", kind, 5).collect() for kind in ("missing", "wrong"))]


def batch(told):
    return [evaluate.rates(told).first(), *(evaluate.most_common(told, kind, 5).collect() for kind in ("missing", "wrong"))]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_replays(spark, tmp_path, seed):
    folder, rng = str(tmp_path), random.Random(seed + 10)
    rows, told = stated(spark, records(seed))
    twice = rows + rng.sample(rows, 60)
    rng.shuffle(twice)
    for start in (0, 80, 160):
        spark.createDataFrame(twice[start : start + 80] if start < 160 else twice[160:], SCHEMA).coalesce(2).write.mode("append").parquet(f"{folder}/log")
        follow(spark, folder)
    assert state(spark, folder) == batch(told)
    # A batch whose end was not noted is done again, and counts once.
    commits = Path(folder, "checkpoint", "commits")
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    follow(spark, folder)
    assert state(spark, folder) == batch(told)


def test_nothing_arrived(spark, tmp_path):
    nothing = evaluate.differences(spark.createDataFrame([], SCHEMA))
    assert state(spark, str(tmp_path)) == batch(nothing)


def provider(folder, die_on=None):
    def factory():
        def answer(value):
            if value == die_on:
                os._exit(1)
            with open(f"{folder}/{os.getpid()}", "a") as log:
                log.write(f"{value}\n")
            if value.startswith("poison"):
                raise ValueError(value)
            return value.upper()

        return answer

    return factory


def calls(folder):
    return Counter(line for p in Path(folder).iterdir() for line in p.read_text().splitlines())


def test_a_run_that_dies_goes_on(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    values = [f"text {i % 60}" for i in range(90)] + ["poison 1", "poison 1", "poison 2", "last", "", "  ", None]
    rows = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "id int, text string, request string")
    ledger = Ledger(spark, str(tmp_path / "ledger"), tries=3)
    with pytest.raises(Exception):  # noqa: B017  the worker dies, whatever Spark makes of it
        ledger.ask(rows, "text", provider(log, die_on="last"), batch=8)
    before, answered = calls(log), ledger.calls().count()
    assert 0 < answered < 63 and answered <= sum(before.values()) <= answered + 16
    known = {r["answer"] for r in ledger.calls().collect()}
    ledger.ask(rows, "text", provider(log), batch=8)
    after = calls(log)
    assert all(after[f"text {i}"] == 1 for i in range(60) if f"TEXT {i}" in known)
    assert sum(n - 1 for v, n in after.items() if v.startswith("text")) == sum(before[v] for v in before if v.startswith("text") and v.upper() not in known)
    assert ledger.dead().select("error", "tries").orderBy("error").collect() == [("ValueError: poison 1", 3), ("ValueError: poison 2", 3)]
    found = {r["id"]: (r["answer"], r["error"], r["tries"] > 0) for r in ledger.answered(rows, "text").collect()}
    assert found == {i: (None, None, False) if not v or not v.strip() else (None, f"ValueError: {v}", True) if v.startswith("poison") else (v.upper(), None, True) for i, v in enumerate(values)}
    assert ledger.ask(rows, "text", provider(log), batch=8) == 0 and calls(log) == after


def test_another_prompt_is_another_call(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one"), ("a", "two"), ("a", None)], "text string, prompt string")
    (tmp_path / "log").mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.ask(rows, "text", provider(tmp_path / "log"), asking=F.col("prompt"))
    assert calls(tmp_path / "log") == {"a": 3}
    assert [r["answer"] for r in ledger.answered(rows, "text", asking=F.col("prompt")).collect()] == ["A"] * 3


def test_no_record_is_a_call_of_python(spark, tmp_path, capsys):
    folder = str(tmp_path)
    spark.createDataFrame(stated(spark, records(3))[0], SCHEMA).write.parquet(f"{folder}/log")
    query = running.follow(shadow.read(spark, f"{folder}/log", SCHEMA), f"{folder}/state", f"{folder}/checkpoint")
    query.awaitTermination()
    query.explain()
    plan = capsys.readouterr().out
    assert "StateStoreSave" in plan and "Pandas" not in plan and "Python" not in plan
