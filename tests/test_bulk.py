"""Whole actions on generated rows, following the reference scenarios in FIXTURES.md."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swathe.model import COMPANY, CONTACT, ActionSpec, RequestError
from swathe.operators.accounting import failed_batch_rows
from swathe.operators.actions import Mutation, register_action
from swathe.operators.batching import plan_batches, plan_from_ids
from swathe.operators.dedup import mark_duplicates
from swathe.operators.targets import ids_frame, select_targets
from swathe.plans.bulk import run_action
from swathe.sources.seeding import seed
from tests.models import sequential_ledger

AS_OF = "2024-02-01 00:00:00"


def contacts(spark, n, dup=0.0):
    return seed(spark, CONTACT, "acct", n, AS_OF, dup, seed=1).cache()


def companies(spark, n, dup=0.0):
    return seed(spark, COMPANY, "acct", n, AS_OF, dup, seed=2).cache()


def update(status="bulk", **changes):
    return ActionSpec(**{**dict(action="update", account="acct", filter={},
                                params={"updates": {"status": status}}), **changes})


def check(result, **counts):
    """Counters, and that every planned entity has exactly one outcome."""
    stats = result.stats.first().asDict()
    assert stats["success_count"] + stats["failure_count"] + stats["skipped_count"] == stats[
        "processed_count"]
    assert stats["processed_count"] == result.outcomes.count()
    for name, want in counts.items():
        assert stats[name] == want, name
    return stats


def test_update_all(spark):
    result = run_action(contacts(spark, 250), CONTACT, update(batch_size=100), AS_OF)
    check(result, total_batches=3, completed_batches=3, success_count=250, status="completed",
          progress_percent=100.0, pending_count=0)
    assert [r.entity_count for r in result.batches.orderBy("batch_index").collect()] == [
        100, 100, 50]
    assert result.table.where("status = 'bulk'").count() == 250


def test_stats_of_duplicates(spark):
    result = run_action(contacts(spark, 60, 0.5), CONTACT,
                        update(dedup_by="email", batch_size=25), AS_OF)
    stats = check(result, processed_count=60, progress_percent=100.0)
    assert stats["skip_breakdown"]["duplicate_email"] == stats["skipped_count"] > 0


def test_columns_must_exist(spark):
    df = contacts(spark, 3)
    for missing, spec in (("status", update()), ("deleted_at", ActionSpec(
            "delete", "acct", filter={})), ("account_id", update()), ("id", update())):
        with pytest.raises(RequestError, match=missing):
            run_action(df.drop(missing), CONTACT, spec, AS_OF)


def test_filter(spark):
    df = contacts(spark, 100)
    active = df.where("status = 'active'").count()
    check(run_action(df, CONTACT, update(filter={"status": "active"}), AS_OF),
          total_entities=active, success_count=active)


def test_explicit_ids(spark):
    df = contacts(spark, 50)
    ids = [r.id for r in df.select("id").limit(5).collect()]
    result = run_action(df, CONTACT, update(filter=None, ids=ids), AS_OF)
    check(result, success_count=5)
    assert result.table.where("status = 'bulk'").count() == 5
    assert result.table.count() == 50


def test_ids_of_another_account_match_nothing(spark):
    df = contacts(spark, 10)
    other = df.withColumns({"account_id": F.lit("other"), "id": F.concat("id", F.lit("x"))})
    ids = [r.id for r in other.select("id").limit(3).collect()]
    both = df.unionByName(other)
    result = run_action(both, CONTACT, update(filter=None, ids=ids), AS_OF)
    stats = check(result, success_count=0, skipped_count=3)
    assert stats["skip_breakdown"] == {"left_target_set": 3}
    assert result.table.where("status = 'bulk'").count() == 0
    named = run_action(both, CONTACT, update(filter=None, ids=ids, report_ids=True), AS_OF)
    stats = check(named, failure_count=3, status="completed_with_errors")
    assert sorted(r.entity_id for r in named.outcomes.collect()) == sorted(ids)


def test_dedup(spark):
    df = contacts(spark, 200, 0.4)
    distinct = df.select(F.countDistinct(F.lower("email"))).first()[0]
    assert distinct < 160
    result = run_action(df, CONTACT, update(dedup_by="email", batch_size=50), AS_OF)
    check(result, success_count=distinct, skipped_count=200 - distinct)
    row = result.outcomes.where("status = 'skipped'").first()
    assert row.reason_code == "duplicate_email" and '"email":' in row.details


def test_dedup_replay_changes_nothing(spark):
    df = contacts(spark, 40, 0.5)
    first = run_action(df, CONTACT, update(dedup_by="email", action_id="x"), AS_OF)
    ledger = first.ledger.cache()
    again = run_action(df, CONTACT, update(dedup_by="email", action_id="x"), AS_OF, ledger=ledger)
    assert sorted(map(tuple, again.outcomes.collect()), key=str) == sorted(
        map(tuple, first.outcomes.collect()), key=str)
    assert again.ledger.count() == 0
    after = run_action(first.table, CONTACT, update(dedup_by="email", action_id="x"), AS_OF,
                       ledger=ledger)
    check(after, success_count=0)
    assert after.table.exceptAll(first.table).count() == 0
    # Another action's claims do not count.
    other = run_action(df, CONTACT, update(dedup_by="email", action_id="y"), AS_OF, ledger=ledger)
    assert other.ledger.count() == ledger.count()


def test_cancel_after_one_batch(spark):
    result = run_action(contacts(spark, 300), CONTACT, update(batch_size=100), AS_OF, stop_after=1)
    check(result, processed_count=100, success_count=100, status="cancelled", total_batches=3,
          pending_count=200)
    states = {r.status: r.n for r in result.batches.groupBy("status").agg(
        F.count("*").alias("n")).collect()}
    assert states == {"completed": 1, "cancelled": 2}
    assert result.table.where("status = 'bulk'").count() == 100


def test_cancel_after_the_end_is_no_cancel(spark):
    result = run_action(contacts(spark, 30), CONTACT, update(batch_size=10), AS_OF, stop_after=3)
    check(result, status="completed", success_count=30)


def test_empty_target(spark):
    result = run_action(contacts(spark, 5), CONTACT, update(filter={"age": 10_000}), AS_OF)
    check(result, status="completed", total_entities=0, total_batches=0, progress_percent=100.0)


def test_drift(spark):
    df = contacts(spark, 100)
    plan = plan_batches(select_targets(df, CONTACT, "acct"), "id", 30)
    gone = [r.id for r in df.orderBy("id").limit(10).collect()]
    left = df.where(~F.col("id").isin(gone))
    result = run_action(left, CONTACT, update(batch_size=30), AS_OF, plan=plan)
    stats = check(result, success_count=90, processed_count=100, total_entities=100)
    assert stats["skip_breakdown"] == {"left_target_set": 10}


def test_rows_that_joined_a_range_are_processed(spark):
    df = contacts(spark, 20).orderBy("id")
    some = df.where("id >= '2'")
    plan = plan_batches(some.where("age > 30"), "id", 5)
    result = run_action(some, CONTACT, update(), AS_OF, plan=plan)
    stats = check(result)
    assert stats["processed_count"] > stats["total_entities"] and stats["pending_count"] == 0
    assert stats["progress_percent"] > 100


def test_no_change(spark):
    df = contacts(spark, 30)
    first = run_action(df, CONTACT, update(), "2024-03-01 00:00:00")
    again = run_action(first.table, CONTACT, update(), "2024-04-01 00:00:00")
    stats = check(again, success_count=0, skipped_count=30)
    assert stats["skip_breakdown"] == {"no_change": 30}
    stamps = {str(r.updated_at) for r in again.table.select("updated_at").distinct().collect()}
    assert stamps == {"2024-03-01 00:00:00"}


def test_null_update_value(spark):
    df = contacts(spark, 6)
    spec = ActionSpec("update", "acct", filter={}, params={"updates": {"age": None}})
    result = run_action(df, CONTACT, spec, AS_OF)
    check(result, success_count=6)
    assert result.table.where("age IS NOT NULL").count() == 0
    assert result.outcomes.first().details == '{"updates":{"age":null}}'
    check(run_action(result.table, CONTACT, spec, AS_OF), skipped_count=6)


def test_failed_batches_leave_no_effect(spark):
    df = contacts(spark, 40, 0.3)
    bad = spark.createDataFrame([(1, "boom " * 500)], "batch_index bigint, error string")
    result = run_action(df, CONTACT, update(batch_size=10, dedup_by="email"), AS_OF, failed=bad)
    stats = check(result, failure_count=10, status="completed_with_errors", processed_count=40)
    assert stats["failure_breakdown"] == {"batch_error": 10}
    assert result.outcomes.select(F.max(F.length("message"))).first()[0] == 1000
    second = [r.id for r in df.orderBy("id").offset(10).limit(10).collect()]
    assert result.table.where(F.col("id").isin(second) & (F.col("status") == "bulk")).count() == 0


def test_companies(spark):
    df = companies(spark, 80)
    spec = ActionSpec("update", "acct", filter={}, batch_size=30,
                      params={"updates": {"industry": "bulk-logistics"}})
    result = run_action(df, COMPANY, spec, AS_OF)
    check(result, success_count=80)
    assert result.table.where("industry <> 'bulk-logistics'").count() == 0
    df = companies(spark, 100, 0.4)
    distinct = df.select(F.countDistinct(F.lower("domain"))).first()[0]
    result = run_action(df, COMPANY, update("reviewed", dedup_by="domain"), AS_OF)
    stats = check(result, success_count=distinct)
    assert set(stats["skip_breakdown"]) == {"duplicate_key"}


def test_deletes(spark):
    df = contacts(spark, 40)
    soft = run_action(df, CONTACT, ActionSpec("delete", "acct", filter={}), AS_OF)
    check(soft, success_count=40)
    assert soft.table.where("deleted_at IS NULL").count() == 0 and soft.table.count() == 40
    check(run_action(soft.table, CONTACT, update(), AS_OF), total_entities=0)
    hard = run_action(df, CONTACT, ActionSpec("delete", "acct", filter={}, params={"hard": True}),
                      AS_OF)
    check(hard, success_count=40)
    assert hard.table.count() == 0
    check(run_action(companies(spark, 15), COMPANY, ActionSpec("delete", "acct", filter={}), AS_OF),
          success_count=15)


def test_tag(spark):
    df = contacts(spark, 25)
    spec = ActionSpec("tag", "acct", filter={}, batch_size=10, params={"suffix": " [VIP]"})
    result = run_action(df, CONTACT, spec, AS_OF)
    check(result, success_count=25, total_batches=3)
    assert result.table.where("name LIKE '% [VIP]'").count() == 25
    assert result.outcomes.count() == 25


def test_an_action_defined_here_needs_nothing_else(spark):
    @register_action("birthday")
    def birthday(entity, params, df):
        return Mutation({"age": F.col("age") + 1}, unchanged=F.col("age").isNull(),
                        details=F.to_json(F.struct("age")), row_details=True)

    df = contacts(spark, 20)
    result = run_action(df, CONTACT, ActionSpec("birthday", "acct", filter={},
                                                dedup_by="email", batch_size=6), AS_OF)
    check(result, success_count=20, total_batches=4)
    old = {r.id: r.age for r in df.collect()}
    assert all(r.age == old[r.id] + 1 for r in result.table.collect())
    assert {r.entity_id: r.details for r in result.outcomes.collect()} == {
        i: f'{{"age":{a}}}' for i, a in old.items()}


def test_other_accounts_are_untouched(spark):
    ours = contacts(spark, 20, 0.5)
    theirs = ours.withColumns({"account_id": F.lit("other"), "id": F.concat("id", F.lit("o"))})
    nobodys = ours.withColumns({"account_id": F.lit(None).cast("string"),
                                "id": F.concat("id", F.lit("n"))})
    everything = ours.unionByName(theirs).unionByName(nobodys)
    for spec in (update(), update(dedup_by="email"),
                 ActionSpec("delete", "acct", filter={}, params={"hard": True}),
                 ActionSpec("delete", "acct", filter={}, dedup_by="email", params={"hard": True})):
        result = run_action(everything, CONTACT, spec, AS_OF)
        rest = result.table.where("coalesce(account_id, '') <> 'acct'")
        assert rest.exceptAll(theirs.unionByName(nobodys)).count() == 0 and rest.count() == 40
        mine = result.table.where("account_id = 'acct'")
        assert mine.exceptAll(result.account_rows).count() == 0
        assert mine.count() == result.account_rows.count()


def test_chunks_of_repeated_ids(spark):
    ids = ids_frame(spark, [7, 3, 9, 1, 5] * 2, "id", "bigint")
    rows = plan_from_ids(ids, "id", 2).orderBy("batch_index").collect()
    assert [r.entity_count for r in rows] == [2, 2, 1]
    assert [r.entity_ids for r in rows] == [[3, 7], [1, 9], [5]]
    assert rows[0].cursor_start == 3 and rows[1].cursor_end == 9


KEYS = st.one_of(st.none(), st.sampled_from(["a", " A ", "b", "B", "", "  ", "c "]))


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(KEYS, min_size=1, max_size=40), st.integers(1, 7))
def test_duplicates_equal_the_sequential_ledger(spark, keys, size):
    rows = list(enumerate(keys))
    df = spark.createDataFrame(rows, "pk int, key string")
    got = {r.pk: r.dedup_class for r in mark_duplicates(df, "pk", "key", ["pk"]).collect()}
    assert got == sequential_ledger(rows, size)


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.9])
def test_seeding(spark, ratio):
    df = contacts(spark, 5_200, ratio)
    assert df.count() == 5_200 and df.select("id").distinct().count() == 5_200
    distinct = df.select("email").distinct().count()
    assert abs((5_200 - distinct) / 5_200 - ratio) < 0.03
    assert df.where("age NOT BETWEEN 18 AND 75").count() == 0
    assert df.exceptAll(seed(spark, CONTACT, "acct", 5_200, AS_OF, ratio, seed=1)).count() == 0


def test_messages_of_failed_batches_are_cut_before_they_are_joined(spark):
    batches = spark.range(3).selectExpr("id AS batch_index", "id AS entity_count")
    errors = spark.range(3).selectExpr("id AS batch_index", "repeat(cast(id AS string), 5000) AS error")
    rows = failed_batch_rows(batches, errors)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Gave up after")
    assert [len(r.message) for r in rows.collect()] == [1000] * 3
