from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swathe.operators import ratelimit as rl
from tests.models import sequential_bucket

PERIOD = 1_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 6)), min_size=1, max_size=60),
       st.integers(6, 9), st.integers(0, 9_000))
def test_run_effect_equals_running_it(steps, cap, level):
    """The piecewise effect of a run gives, for any starting level, the level after running it."""
    level = min(level, cap * PERIOD)
    at = np.cumsum([gap for gap, _ in steps])
    amount = np.array([a for _, a in steps])
    limit = np.full(len(steps), cap)
    start, value, moves = rl._run_effect(at, amount, limit, PERIOD)
    i = int(np.searchsorted(start, level, side="right")) - 1
    effect = value[i] + (level if moves[i] else 0)
    _, levels = rl._decide(at, amount, limit, PERIOD, level)
    assert effect == levels[-1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(3, 9)), min_size=1, max_size=40))
def test_run_effect_with_changing_limits(steps):
    at = np.cumsum([gap for gap, _ in steps])
    limit = np.array([c for _, c in steps])
    amount = np.minimum(limit, 2)
    start, value, moves = rl._run_effect(at, amount, limit, PERIOD)
    for level in range(0, int(limit[0]) * PERIOD + 1, 97):
        i = int(np.searchsorted(start, level, side="right")) - 1
        assert value[i] + (level if moves[i] else 0) == rl._decide(
            at, amount, limit, PERIOD, level)[1][-1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 6)), min_size=2, max_size=40),
       st.integers(1, 39))
def test_run_effect_continues_over_batches(steps, cut):
    at = np.cumsum([gap for gap, _ in steps])
    amount, limit = np.array([a for _, a in steps]), np.full(len(steps), 7)
    cut = min(cut, len(steps) - 1)
    first = rl._run_effect(at[:cut], amount[:cut], limit[:cut], PERIOD)
    split = rl._run_effect(at[cut:], amount[cut:], limit[cut:], PERIOD, first, int(at[cut - 1]))
    whole = rl._run_effect(at, amount, limit, PERIOD)
    assert all((a == b).all() for a, b in zip(split, whole))


def test_pieces_stay_few_for_requests_of_one_size():
    n = 3_000
    at = np.arange(n) * 7
    start, _, _ = rl._run_effect(at, np.full(n, 10), np.full(n, 120), PERIOD)
    assert len(start) <= 15


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 6)), min_size=1, max_size=60),
       st.integers(6, 9), st.integers(0, 9_000), st.integers(0, 9_000))
def test_bounds_hold_and_the_effect_on_a_range_is_exact(steps, cap, a, b):
    low, high = sorted((min(a, cap * PERIOD), min(b, cap * PERIOD)))
    at = np.cumsum([gap for gap, _ in steps])
    amount, limit = np.array([a for _, a in steps]), np.full(len(steps), cap)
    least, most = rl._reach(at, amount, limit, PERIOD, low, high)
    start, value, moves = rl._run_effect(at, amount, limit, PERIOD, domain=(low, high))
    assert start[0] == low and start[-1] == high + 1
    for level in {low, high, (low + high) // 2, min(high, low + 1)}:
        end = rl._decide(at, amount, limit, PERIOD, level)[1][-1]
        assert least <= end <= most
        i = int(np.searchsorted(start[:-1], level, side="right")) - 1
        assert value[i] + (level if moves[i] else 0) == end


def test_a_busy_bucket_with_a_high_limit_leaves_a_narrow_range():
    """Requests for 1 at a limit of 10,000: any level would make thousands of pieces; what a busy
    run can end with makes a handful, and work per request is a few microseconds."""
    n, cap, period = 60_000, 10_000, rl.MINUTE_MS
    at = np.arange(n) * 2
    amount, limit = np.ones(n, np.int64), np.full(n, cap)
    bounds = rl._reach(at, amount, limit, period, 0, cap * period)
    assert bounds[1] - bounds[0] <= 2 * period
    started = time.process_time()
    start, _, _ = rl._run_effect(at[:5_000], amount[:5_000], limit[:5_000], period, domain=bounds)
    assert len(start) <= 8 and time.process_time() - started < 5


def test_hot_account_over_many_runs(many_parts):
    """One account owns most requests and spans several runs; decisions equal the plain loop."""
    rng = random.Random(11)
    data, clock = [], 0
    for i in range(1_500):
        clock += rng.choice([0, 1, 3, 9, 40, 400])
        account = "hot" if rng.random() < 0.7 else f"a{rng.randint(0, 5)}"
        data.append((i, account, clock, rng.choice([-1, 0, 1, 2, 2, 3, 12]), 10))
    many_parts.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    df = many_parts.createDataFrame(data, "id int, acc string, ms bigint, n int, cap int")
    df = df.selectExpr("*", "timestamp_millis(ms) AS at").repartition(6)
    laid = rl.ordered_layout(df.where("acc = 'hot'"), ["acc", "at", "id"])
    assert laid.select("_part").distinct().count() > 3
    out = rl.token_bucket(df, "acc", ["at", "id"], "at", "n", "cap", PERIOD)
    got = {r.id: (r.allowed, r.tokens_remaining) for r in out.collect()}
    many_parts.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(data)
    for account in {d[1] for d in data}:
        mine = [d for d in data if d[1] == account]
        for d, (ok, level) in zip(mine, sequential_bucket([(m, n, c) for _, _, m, n, c in mine],
                                                          PERIOD)):
            assert got[d[0]][0] == ok
            if level is not None:
                assert got[d[0]][1] == level / PERIOD


def test_buckets_continue_over_triggers_and_replays(many_parts, tmp_path):
    """A stream cut into triggers, one of them delivered twice, with a hot account."""
    from swathe.streaming.admission import bucket_step
    rng, data, clock = random.Random(4), [], 0
    for i in range(600):
        clock += rng.choice([0, 3, 40, 90, 5_000 if i % 97 == 0 else 20])
        data.append((i, "hot" if rng.random() < 0.6 or i % 200 == 199 else f"a{i % 9}", clock,
                     0 if i % 200 == 199 else rng.choice([0, 1, 2, 3, 11]), 10))
    df = many_parts.createDataFrame(data, "id int, acc string, ms bigint, n int, cap int")
    df = df.selectExpr("*", "timestamp_millis(ms) AS at").repartition(6)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    step = bucket_step("acc", ["id"], "at", "n", "cap", out, state, PERIOD)
    for trigger in (0, 1, 1, 2):
        step(df.where(f"id div 200 = {trigger}"), trigger)
    got = {r.id: (r.allowed, r.tokens_remaining) for r in many_parts.read.parquet(out).collect()}
    assert len(got) == len(data)
    for account in {d[1] for d in data}:
        mine = [d for d in data if d[1] == account]
        for d, (ok, level) in zip(mine, sequential_bucket([(m, n, c) for _, _, m, n, c in mine],
                                                          PERIOD)):
            assert got[d[0]][0] == ok
            if level is not None:
                assert got[d[0]][1] == level / PERIOD


def test_submission_limit_rejects_the_third(spark):
    df = spark.createDataFrame([(i, 1, 1_000 + i) for i in range(3)], "id int, acc int, ms bigint")
    df = df.selectExpr("*", "timestamp_millis(ms) AS at")
    out = rl.submission_limit(df, ["at", "id"], "at", account="acc", per_minute=2).collect()
    rows = {r.id: r for r in out}
    assert [rows[i].allowed for i in range(3)] == [True, True, False]
    assert rows[2].retry_after_seconds > 0


def test_second_batch_is_deferred(spark):
    batches = spark.createDataFrame([(1, 0, 100, 5_000), (1, 1, 100, 5_000)],
                                    "account_id int, batch_index int, entity_count int, ms bigint"
                                    ).selectExpr("*", "timestamp_millis(ms) AS at")
    accounts = spark.createDataFrame([(1, 120)], "account_id int, rate_limit_per_minute int")
    decided = rl.admit_batches(batches, accounts, ["at", "batch_index"], "at")
    assert {r.batch_index: r.allowed for r in decided.collect()} == {0: True, 1: False}
    row = rl.deferrals(decided, "at").collect()[0]
    assert row.status == "pending" and row.batch_index == 1
    # 80 tokens are missing at 2 tokens a second.
    assert row.retry_after_ms == 40_050


@pytest.mark.parametrize(("limit", "want"), [(10, 120_000), (10_000, 120_000)])
def test_idle_timeout(spark, limit, want):
    from pyspark.sql import functions as F
    assert spark.range(1).select(rl.idle_timeout_ms(F.lit(limit))).first()[0] == want
