"""Versions by copy on write, commits of several writers, actions in several goes."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from checks.fixtures import ORDERS, orders
from swathe.model import ActionSpec, ConflictError
from swathe.plans import resume
from swathe.plans.bulk import run_action
from swathe.sources.publish import commit
from swathe.sources.staging import staging_path
from swathe.sources.store import Log, Store, insert_if_absent
from tests.conftest import SF

SPEC = ActionSpec("update", "2-HIGH", {"o_orderstatus": "F"}, None, "o_custkey", 10,
                  {"updates": {"o_orderstatus": "X"}}, "goes", rate_limit_per_minute=40)
COLUMNS = ["o_orderkey", "o_orderstatus", "updated_at", "deleted_at"]


def fresh(spark, files=6):
    store = Store(spark, staging_path(spark, "store"))
    store.create(orders(spark, SF).repartitionByRange(files, "o_orderkey"))
    return store


def bag(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_only_touched_files_are_written(spark):
    store = fresh(spark)
    before = {r.file: r for r in store.manifest().collect()}
    keys = store.table().where("o_orderkey < 100").select("o_orderkey")
    changed = store.change(keys, lambda rows: rows.withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") < 100, -1.0).otherwise(F.col("o_totalprice"))))
    after = {r.file: r for r in store.manifest().collect()}
    assert changed == 2 and len(before) == len(after) == 6
    assert len(set(before) - set(after)) == 1 and sum(r.rows for r in after.values()) == 1500
    written = sum(r.bytes for f, r in after.items() if f not in before)
    assert written < 0.3 * sum(r.bytes for r in after.values())
    assert store.table().where("o_totalprice = -1").count() == 100
    assert store.table(1).where("o_totalprice = -1").count() == 0
    # By predicate; rows may go, and a change that touches nothing writes nothing.
    assert store.change(F.col("o_orderkey") >= 1400, lambda rows: rows.where("o_orderkey < 1400")) == 3
    assert store.table().count() == 1400 and store.table(2).count() == 1500
    files = set(r.file for r in store.manifest().collect())
    assert store.change(F.col("o_orderkey") < 0, lambda rows: rows) == 4
    assert set(r.file for r in store.manifest().collect()) == files
    doomed = store.vacuum(keep=2)
    assert set(doomed) == (set(before) | set(after)) - files
    assert store.table().count() == store.table(3).count() == 1400


def test_one_writer_per_version(spark):
    store = fresh(spark, 2)
    rows = spark.range(3)
    assert store.add_rows({"x": rows}, base=1) == 2
    assert store.add_rows({"x": rows}, base=1) is None          # somebody was faster
    assert store.change(F.col("o_orderkey") < 10, lambda r: r.limit(0), {"x": rows}, base=1) is None
    assert store.rows("x").count() == 3 and store.table().count() == 1500
    log = Log(spark, staging_path(spark, "log"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.append(1, {"who": i}), range(8)))
    assert sum(won) == 1 and log.read(1)["who"] == won.index(True)
    with pytest.raises(ConflictError):
        store.create(rows)


def test_claims_are_won_once(spark):
    store = Store(spark, staging_path(spark, "claims"))
    store.create(spark.range(0))
    parts = [spark.createDataFrame([(f"k{i % 40}", w, i) for i in range(w, 60 + w)],
                                   "key string, writer int, row int") for w in range(3)]
    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(lambda p: insert_if_absent(store, "claims", p, ["key"]).collect(), parts))
    stored = store.rows("claims").collect()
    assert len(stored) == len({r.key for r in stored}) == 40
    assert sorted(r for w in won for r in w) == sorted(stored)
    assert insert_if_absent(store, "claims", parts[0], ["key"]).count() == 0


def test_goes_equal_one_run(spark):
    table = orders(spark, SF).cache()
    one = run_action(table, ORDERS, SPEC, "2024-03-01 00:00:00")
    n = one.batches.count()
    assert n > 8
    store = fresh(spark)
    assert resume.submit(store, ORDERS, SPEC, "2024-03-01 00:00:00")
    assert not resume.submit(store, ORDERS, SPEC, "2024-03-01 00:00:00")
    states, minute = [], 0
    while True:
        go = resume.advance(store, ORDERS, SPEC, f"2024-03-01 00:{minute:02d}:00")
        minute += 1
        if go.version is None:
            break
        states.append([r.status for r in resume.batches(store, "goes").orderBy("batch_index").collect()])
    assert [s.count("completed") for s in states] == [min(4 * k, n) for k in range(1, len(states) + 1)]
    assert all(s == sorted(s) for s in states)  # in order: completed ones first, then pending
    outcome = ["batch_index", "entity_id", "status", "reason_code", "message", "details"]
    assert bag(store.rows("outcomes", action="goes"), outcome) == bag(one.outcomes, outcome)
    keys = ["o_orderkey", "o_orderstatus", "deleted_at"]
    assert bag(store.table(), keys) == bag(one.table, keys)
    counts = ["success_count", "skipped_count", "total_entities", "total_batches", "status",
              "completed_batches", "skip_breakdown"]
    assert bag(resume.statistics(store, ORDERS, SPEC), counts) == bag(one.stats, counts)


@pytest.mark.parametrize("dedup", [None, "o_custkey"])
def test_an_action_is_committed_with_its_table(spark, dedup):
    spec = ActionSpec("update", "2-HIGH", {"o_custkey": {"lt": 20}}, None, dedup, 10,
                      {"updates": {"o_orderstatus": "X"}}, "one")
    store = Store(spark, staging_path(spark, "store"))
    store.create(orders(spark, SF).repartitionByRange(6, "o_custkey"))
    before = {r.file for r in store.manifest().collect()}
    result = run_action(store.table(), ORDERS, spec, "2024-03-01 00:00:00")
    want, outcomes = bag(result.table, COLUMNS), bag(result.outcomes, ["entity_id", "reason_code"])
    assert commit(result, store, 1) == 2
    assert bag(store.table(), COLUMNS) == want
    assert bag(store.rows("outcomes"), ["entity_id", "reason_code"]) == outcomes
    assert len(before & {r.file for r in store.manifest().collect()}) == 5  # of 6
    again = run_action(store.table(1), ORDERS, spec, "2024-03-01 00:00:00")
    assert commit(again, store, 1) is None  # made of an old version


def test_deferred_failed_and_cancelled(spark):
    store = fresh(spark)
    resume.submit(store, ORDERS, SPEC, "2024-03-01 00:00:00")
    gave_up = spark.createDataFrame([(1, "disk full"), (6, "later")], "batch_index bigint, error string")
    first = resume.advance(store, ORDERS, SPEC, "2024-03-01 00:00:00", limit=2, failed=gave_up)
    state = {r.batch_index: r.status for r in resume.batches(store, "goes").collect()}
    assert [state[i] for i in range(4)] == ["completed", "failed", "pending", "pending"]
    reasons = {r.reason_code for r in store.rows("outcomes").where("batch_index = 1").collect()}
    assert reasons == {"batch_error"} and first.deferred.count() > 0
    # Another writer commits while a go runs: the go starts again from there.
    original, raced = store.change, []

    def race(*args, **kwargs):
        if not raced:
            raced.append(store.add_rows({"other": spark.range(1)}))
        return original(*args, **kwargs)

    store.change = race
    second = resume.advance(store, ORDERS, SPEC, "2024-03-01 00:01:00", limit=1)
    assert raced and second.version == raced[0] + 1
    done = resume.cancel(store, "goes", "2024-03-01 00:02:00")
    assert done and resume.cancel(store, "goes", "2024-03-01 00:03:00") is None
    assert resume.advance(store, ORDERS, SPEC, "2024-03-01 00:04:00").version is None
    stats = resume.statistics(store, ORDERS, SPEC).first()
    assert stats.status == "cancelled" and stats.completed_batches == 3
    assert stats.processed_count == 30 and stats.failure_count == 10
    assert store.table().where("o_orderstatus = 'X'").count() == stats.success_count
    assert store.table(1).where("o_orderstatus = 'X'").count() == 0


def test_scan_reads_only_the_open_ranges(spark):
    store = fresh(spark)
    resume.submit(store, ORDERS, SPEC, "2024-03-01 00:00:00")
    chosen = resume.batches(store, "goes").where("batch_index IN (1, 2, 5)")
    plan = store.table().where(resume._key_ranges(chosen, "o_orderkey"))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(o_orderkey" in plan


def test_names_of_files_are_taken_once_per_file(spark):
    store = fresh(spark, 2)
    written = store._write_files(store.table())
    plan = written._jdf.queryExecution().optimizedPlan().toString()
    # Above the aggregation, which groups by the plain path.
    assert plan.index("regexp_extract") < plan.index("Aggregate")
    assert "regexp_extract" not in plan[plan.index("Aggregate"):]
    assert sum(r.rows for r in written.collect()) == 1500
