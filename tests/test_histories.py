"""Histories, removals along references, deep pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from swathe.model import ACTION_STATUSES
from swathe.operators import lifecycle
from swathe.operators.accounting import transition_allowed
from swathe.operators.lifecycle import final_statuses, fold_statuses, may_follow
from swathe.operators.mutate import Reference, cascade, cascade_delete
from swathe.operators.paging import Pages


def test_rule_equals_the_guard(spark):
    pairs = [(a, b) for a in ACTION_STATUSES for b in ACTION_STATUSES]
    found = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", transition_allowed("a", "b").alias("ok")).collect()
    assert all(r.ok == may_follow(r.a, r.b) for r in found)


@pytest.mark.parametrize("fan", [3, 1024])
def test_folded_histories(spark, monkeypatch, fan):
    monkeypatch.setattr(lifecycle, "FAN", fan)
    draw = random.Random(fan)
    likely = ["scheduled", "queued", "planning", "processing", "processing", "nonsense", None]
    events = [(k, i, draw.choice(likely if draw.random() < 0.97 else ACTION_STATUSES))
              for k, n in ((1, 90), (2, 1), (None, 12), (4, 40)) for i in range(n)]
    df = spark.createDataFrame(events, "k int, i int, status string").repartition(3)
    folded = fold_statuses(df, "k", ["i"], start="scheduled")
    want, last = [], {}
    for k, i, status in events:
        before = last.get(k, "scheduled")
        ok = status in ACTION_STATUSES and may_follow(before, status)
        last[k] = status if ok else before
        want.append((k, i, status, before, last[k], ok))
    columns = ["k", "i", "status", "before", "after", "allowed"]
    assert sorted(map(tuple, folded.select(*columns).collect()), key=str) == sorted(want, key=str)
    ends = {r.k: (r.status, r.steps, r.refused) for r in final_statuses(folded, "k", ["i"]).collect()}
    assert ends == {k: (last[k], sum(w[0] == k for w in want), sum(w[0] == k and not w[5] for w in want))
                    for k in last}
    assert fold_statuses(df.limit(0), "k", ["i"]).count() == 0


def test_a_second_parent_does_not_bring_rows_back(spark):
    root = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(10, 1, 2), (11, 2, 1), (12, 2, 2), (13, None, 2)], "c int, a int, b int")
    kept = cascade_delete(root, "id", root.where("id = 1"), [
        ("child", child, "a", None, "root"), ("child", child, "b", None, "root")])
    assert {r.c for r in kept["child"].collect()} == {12, 13}
    assert {r.id for r in kept["root"].collect()} == {2}


def test_cycles_and_chains(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([None, draw.randrange(60), i - 1 if i else None])) for i in range(60)]
    a = spark.createDataFrame(rows, "id int, up int")
    b = spark.createDataFrame([(100 + i, draw.randrange(60)) for i in range(40)], "id int, a int")
    back = spark.createDataFrame([(i, 100 + draw.randrange(40) if i % 3 else None) for i in range(60)],
                                 "owner int, b int")
    a = a.join(back, F.col("id") == F.col("owner")).drop("owner")
    data = {r.id: (r.up, r.b) for r in a.collect()}
    other = {r.id: r.a for r in b.collect()}
    gone, gone_b = {5, 41}, set()
    while True:
        more = {i for i, (up, x) in data.items() if up in gone or x in gone_b} - gone
        more_b = {i for i, x in other.items() if x in gone} - gone_b
        if not more | more_b:
            break
        gone |= more
        gone_b |= more_b
    kept = cascade({"a": a, "b": b}, {"a": "id", "b": "id"},
                   [Reference("a", "up", "a"), Reference("b", "a", "a"), Reference("a", "b", "b")],
                   {"a": spark.createDataFrame([(5,), (41,), (None,)], "id int")})
    assert {r.id for r in kept["a"].collect()} == set(data) - gone
    assert {r.id for r in kept["b"].collect()} == set(other) - gone_b


def test_pages_of_any_depth(spark, many_parts):
    draw = random.Random(3)
    rows = [(i, draw.randrange(7)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    pages = Pages(df, [F.col("v").desc(), F.col("id")])
    for limit, offset in ((50, 0), (50, 433), (7, 499), (10, 500), (1000, 3), (0, 10)):
        got = pages.page(limit, offset).collect()
        assert [(r.id, r.v) for r in got] == want[offset:offset + limit]
        assert all(r.total == 500 and r.has_more == (500 > offset + limit) for r in got)
    plan = pages.page(5, 300)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(_mid" in plan  # read by place, not skipped over
    pages.release()
    assert Pages(df.limit(0), ["id"]).page(5).count() == 0


def test_steps_are_not_broadcast(spark):
    events = spark.range(100).selectExpr("id % 7 AS k", "id AS i", "'planning' AS status")
    folded = fold_statuses(events, "k", ["i"])
    assert "BroadcastHashJoin" not in folded._jdf.queryExecution().executedPlan().toString()
    assert folded.where("allowed").count() == 100
