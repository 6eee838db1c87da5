"""Keyed state over many triggers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from swathe.sources.keyed import KeyedState
from swathe.streaming import apply


def test_newest_row_per_key_and_few_runs(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), ["a", "b"], buckets=4, fan=3)
    draw, want, before = random.Random(2), {}, {}
    for trigger in range(22):
        rows = {(draw.choice([None, "x", "y"]), draw.randrange(12)): draw.random() for _ in range(6)}
        frame = spark.createDataFrame([(*k, v) for k, v in rows.items()], "a string, b int, v double")
        for _ in range(2 if trigger % 7 == 3 else 1):  # some are delivered again
            state.compact(trigger)
            seen = state.read(trigger)
            got = {} if seen is None else {(r.a, r.b): r.v for r in seen.collect()}
            assert got == want
            state.write(trigger, frame)
        want = want | rows
    assert len(state.runs()) <= 8  # of 22 triggers
    assert state.runs()[0][0] == 0 and state.runs()[-1][1] == 21
    asked = spark.createDataFrame([("x", 3), ("y", 7), ("z", 1)], "a string, b int")
    found = {(r.a, r.b): r.v for r in state.lookup(asked).collect()}
    assert found == {k: want[k] for k in (("x", 3), ("y", 7)) if k in want}
    assert state.lookup(asked.limit(0)).count() == 0


def test_a_lookup_opens_its_buckets_only(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), ["k"], buckets=32, fan=4)
    for trigger in range(3):
        state.write(trigger, spark.range(trigger * 500, trigger * 500 + 500).withColumnRenamed("id", "k"))
    one = spark.range(7, 8).withColumnRenamed("id", "k")
    plan = state.lookup(one)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [(r.k, r.version) for r in state.lookup(one).collect()] == [(7, 0)]


def test_ledger_of_many_triggers(spark, tmp_path, monkeypatch):
    """First wins over thirty triggers, with merged runs in between."""
    plain = apply.KeyedState
    monkeypatch.setattr(apply, "KeyedState", lambda s, root, keys: plain(s, root, keys, 4, 3))
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    step = apply.dedup_step("id", "who", out, ledger)
    rows = spark.range(300).selectExpr("id", "concat('k', (id * 37) % 90) AS who")
    for trigger in range(15):
        step(rows.where(F.col("id").between(trigger * 20, trigger * 20 + 19)), trigger)
    marked = {r.id: r for r in spark.read.parquet(out).collect()}
    first = {}
    for i in range(300):
        first.setdefault(f"k{i * 37 % 90}", i)
    assert {i for i, r in marked.items() if r.dedup_class == "unique"} == set(first.values())
    held = plain(spark, ledger, ["dedup_key"], 4, 3)
    assert {r.dedup_key: r.winner_pk for r in held.read().collect()} == first
    assert len(held.runs()) <= 7
