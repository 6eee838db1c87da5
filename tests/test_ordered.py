"""Order-dependent operators with keys spread over several parts and one hot key."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from swathe.operators import ordered
from swathe.operators.batching import plan_batches, resolve_batches
from tests.models import keyset_batches


@pytest.fixture
def rows(many_parts):
    rng = random.Random(5)
    data = [(None if rng.random() < 0.1 else rng.choice(["hot"] * 6 + ["a", "b", "c"]), i,
             rng.randint(-5, 20)) for i in range(400)]
    df = many_parts.createDataFrame(data, "k string, t int, v int").repartition(5)
    return data, df


def by_key(data):
    groups = {}
    for k, t, v in sorted(data, key=lambda r: r[1]):
        groups.setdefault(k, []).append((t, v))
    return groups


def test_layout_has_several_parts(rows):
    laid = ordered.ordered_layout(rows[1], ["k", "t"])
    assert laid.select("_part").distinct().count() > 3


def test_global_rank(rows):
    data, df = rows
    got = {r.t: r.n for r in ordered.global_rank(df, ["v", "t"], "n").collect()}
    want = {t: i + 1 for i, (v, t) in enumerate(sorted((v, t) for _, t, v in data))}
    assert got == want


def test_running_sum_of_a_key_that_spans_parts(rows):
    data, df = rows
    out = ordered.running_sum(df, ["k"], ["t"], {"s": "v", "n": F.lit(1)})
    assert out.columns == ["k", "t", "v", "s", "n"]
    got = {(r.k, r.t): (r.s, r.n) for r in out.collect()}
    for k, items in by_key(data).items():
        total = 0
        for n, (t, v) in enumerate(items, 1):
            total += v
            assert got[(k, t)] == (total, n)


def test_running_sum_without_keys(rows):
    data, df = rows
    got = {r.t: r.s for r in ordered.running_sum(df, [], ["t"], {"s": "v"}).collect()}
    total = 0
    for _, t, v in sorted(data, key=lambda r: r[1]):
        total += v
        assert got[t] == total


def test_rank_within(rows):
    data, df = rows
    got = {(r.k, r.t): r["rank"] for r in ordered.rank_within(df, ["k"], ["t"]).collect()}
    for k, items in by_key(data).items():
        for n, (t, _) in enumerate(items, 1):
            assert got[(k, t)] == n


def test_previous_row(rows):
    data, df = rows
    out = ordered.previous_row(df, ["k"], ["t"], {"pt": "t", "pv": "v"})
    got = {(r.k, r.t): (r.pt, r.pv) for r in out.collect()}
    for k, items in by_key(data).items():
        before = (None, None)
        for t, v in items:
            assert got[(k, t)] == before
            before = (t, v)


def test_carry_forward(many_parts):
    marks = {0, 37, 38, 120}
    df = many_parts.range(200).select(
        "id", F.when(F.col("id").isin(*marks), F.col("id")).alias("m"))
    got = {r.id: r.f for r in ordered.carry_forward(df, ["id"], "m", "f").collect()}
    for i in range(200):
        assert got[i] == max(m for m in marks if m <= i)


def test_median_within(rows):
    data, df = rows
    got = {r.k: r["median"] for r in ordered.median_within(df, ["k"], "v", ["t"]).collect()
           if r.k is not None}
    for k, items in by_key(data).items():
        if k is not None:
            assert got[k] == statistics.median(v for _, v in items)


def test_mark_first(rows):
    data, df = rows
    got = {r.t: r.is_first for r in ordered.mark_first(df, ["k"], ["v"], "t").collect()}
    best = {}
    for k, t, v in data:
        if k is not None:
            best[k] = min(best.get(k, (v, t)), (v, t))
    for k, t, v in data:
        assert got[t] == (k is None or best[k] == (v, t))


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_plan_of_text_keys(many_parts, size):
    import hashlib
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(300)]
    df = many_parts.createDataFrame([(k,) for k in keys], "id string").repartition(4)
    got = sorted(tuple(r)[:4] for r in plan_batches(df, "id", size).collect())
    assert got == keyset_batches(keys, size)


def test_resolve_batches_across_parts(many_parts):
    df = many_parts.range(0, 600, 2)
    plan = plan_batches(df, "id", 40)
    later = many_parts.range(600)
    ranges = [tuple(r) for r in plan.select("batch_index", "cursor_start", "cursor_end").collect()]
    got = {r.id: r.batch_index for r in resolve_batches(later, "id", plan).collect()}
    want = {i: b for b, lo, hi in ranges for i in range(lo, hi + 1)}
    assert got == want


def test_no_single_task_over_all_rows(rows):
    """The only unpartitioned windows see one row per part."""
    plan = ordered.global_rank(rows[1], ["t"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("== Physical Plan ==")[1]


def test_a_hot_key_does_not_end_up_in_one_task(many_parts):
    from swathe.operators.dedup import mark_duplicates
    many_parts.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    n = 20_000
    rows = many_parts.range(n).selectExpr("id", "if(id % 2 = 0, 'hot', concat('k', id)) AS k")
    out = mark_duplicates(rows, "id", "k", ["id"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    many_parts.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == n and max(sizes) < n / 4
    laid = ordered.ordered_layout(rows, ["k", "id"])
    sizes = [r["count"] for r in laid.groupBy("_part").count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 4
