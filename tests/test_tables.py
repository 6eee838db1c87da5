"""What is written is what is read: audit rows, snapshots, write-back, control rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from swathe.model import CONTACT, ActionSpec
from swathe.plans.bulk import numbered_outcomes, run_action
from swathe.operators.paging import keyset_page, log_filter
from swathe.sources import tables
from swathe.sources.publish import claimed_before, next_version, publish
from swathe.sources.seeding import seed
from swathe.sources.staging import stage, staging_root

AS_OF = "2024-02-01 00:00:00"


def action(name, status="bulk", **changes):
    return ActionSpec(**{**dict(action="update", account="a", filter={}, action_id=name,
                                params={"updates": {"status": status}}), **changes})


@pytest.fixture
def two_accounts(spark):
    return seed(spark, CONTACT, "a", 40, AS_OF, 0.3, seed=1).unionByName(
        seed(spark, CONTACT, "b", 25, AS_OF, 0.3, seed=2))


def test_staging_follows_the_session(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = spark.range(5).selectExpr("id", "id * 2 AS x")
    staged = stage(df, "t")
    assert staged.schema.names == df.schema.names
    assert staged.inputFiles() and all(staging_root(spark) in f for f in staged.inputFiles())


def test_audit_rows_append_and_replace(spark, two_accounts, tmp_path):
    path = str(tmp_path / "log")
    for name in ("x", "y"):
        result = run_action(two_accounts, CONTACT, action(name, batch_size=15), AS_OF)
        tables.append_outcomes(numbered_outcomes(result.outcomes), path)
    assert spark.read.parquet(path).groupBy("action_id").count().where("count = 40").count() == 2
    # A repeated run of one action replaces that action's rows only.
    again = run_action(two_accounts, CONTACT, action("y", batch_size=15), AS_OF)
    tables.replace_outcomes(numbered_outcomes(again.outcomes), path)
    logs = spark.read.parquet(path)
    assert logs.count() == 80
    seen, cursor = [], None
    while True:
        page = keyset_page(log_filter(logs, action_id="y"), "log_id", 15, cursor).collect()
        seen += [r.log_id for r in page]
        cursor = page[-1].next_cursor
        if not page[-1].has_more:
            break
        assert len(page) == 15
    assert cursor is None and len(seen) == len(set(seen)) == 40 and seen == sorted(seen)


def test_write_back_touches_one_account(spark, two_accounts, tmp_path):
    path = str(tmp_path / "contacts")
    two_accounts.write.partitionBy("account_id").parquet(path)
    before = sorted(f.name for f in (tmp_path / "contacts" / "account_id=b").iterdir())
    table = spark.read.parquet(path)
    result = run_action(table, CONTACT, action("x", dedup_by="email"), AS_OF)
    winners = result.stats.first().success_count
    tables.overwrite_account(result.account_rows, path, "account_id", "a")
    result.release()
    after = tables.read_entity(spark, path, CONTACT)
    assert after.count() == 65
    assert after.where("status = 'bulk' AND account_id = 'a'").count() == winners
    assert after.where("status = 'bulk' AND account_id = 'b'").count() == 0
    assert before == sorted(f.name for f in (tmp_path / "contacts" / "account_id=b").iterdir())
    one = tables.read_entity(spark, path, CONTACT, "b")
    assert one.count() == 25
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(account_id" in plan


def test_write_back_of_an_emptied_account(spark, two_accounts, tmp_path):
    path = str(tmp_path / "contacts")
    odd = two_accounts.withColumn(
        "account_id", F.when(F.col("account_id") == "a", "a b/ü").otherwise("b"))
    odd.write.partitionBy("account_id").parquet(path)
    result = run_action(spark.read.parquet(path), CONTACT, ActionSpec(
        "delete", "a b/ü", filter={}, params={"hard": True}), AS_OF)
    tables.overwrite_account(result.account_rows, path, "account_id", "a b/ü")
    left = spark.read.parquet(path)
    assert left.count() == left.where("account_id = 'b'").count() == 25


def test_versions(spark, two_accounts, tmp_path):
    root = str(tmp_path / "versions")
    assert tables.latest_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, root)
    tables.write_version(two_accounts, root, 1, ["account_id"])
    result = run_action(tables.read_version(spark, root), CONTACT,
                        ActionSpec("delete", "a", filter={}, params={"hard": True}), AS_OF)
    tables.write_version(result.table, root, 2, ["account_id"])
    (tmp_path / "versions" / "version=3").mkdir()   # an unfinished write is not a version
    assert tables.latest_version(spark, root) == 2
    assert tables.read_version(spark, root).count() == 25
    assert tables.read_version(spark, root, 1).count() == 65


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "batches")
    rows = spark.range(5).selectExpr("'x' AS action_id", "id AS batch_index", "id * 10 AS n")
    assert tables.insert_if_absent(rows, path, ["action_id", "batch_index"]).count() == 5
    more = spark.range(3, 8).selectExpr("'x' AS action_id", "id AS batch_index", "-id AS n")
    fresh = tables.insert_if_absent(more.unionByName(more), path, ["action_id", "batch_index"])
    assert sorted(r.batch_index for r in fresh.collect()) == [5, 6, 7]
    stored = spark.read.parquet(path)
    assert stored.count() == 8 and stored.where("batch_index = 4").first().n == 40


def test_submission_rows(spark, tmp_path):
    path = str(tmp_path / "submissions")
    spec = action("x", filter=None, ids=["1", "2"], dedup_by="email")
    row = tables.submission_row(spark, CONTACT, spec, 500, AS_OF, {"status": "queued"})
    tables.append_submissions(row, path)
    tables.append_submissions(row.withColumn("action_id", F.lit("y")), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    assert json.loads(stored.first().configuration) == {
        "updates": {"status": "bulk"}, "entity_ids": ["1", "2"], "deduplicate_by": "email"}


def test_running_twice_gives_the_same(spark, two_accounts):
    def run():
        r = run_action(two_accounts, CONTACT, action("x", dedup_by="email", batch_size=7), AS_OF)
        return [sorted(map(str, d.collect())) for d in (r.outcomes, r.batches, r.table, r.ledger)]
    assert run() == run()


def test_deduplicated_update_of_one_account_joins_only_that_account(spark, two_accounts, tmp_path):
    path = str(tmp_path / "p")
    two_accounts.write.partitionBy("account_id").parquet(path)
    result = run_action(spark.read.parquet(path), CONTACT, action("x", dedup_by="email"), AS_OF)
    plan = result.table._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    plain = run_action(spark.read.parquet(path), CONTACT, action("x"), AS_OF)
    plan = plain.table._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_publish_and_run_again(spark, two_accounts, tmp_path):
    root = str(tmp_path / "store")
    assert claimed_before(spark, root) is None
    tables.write_version(two_accounts, f"{root}/table", next_version(spark, root))

    def run(version):
        source = tables.read_version(spark, f"{root}/table", 1)
        result = run_action(source, CONTACT, action("x", dedup_by="email", batch_size=9), AS_OF,
                            ledger=claimed_before(spark, root))
        publish(result, root, version)
        names = ("outcomes", "batches", "stats", "ledger", "table/version=2")
        return {n: sorted(map(str, spark.read.parquet(f"{root}/{n}").collect())) for n in names}

    first = run(next_version(spark, root))
    assert len(first["outcomes"]) == 40 and len(first["stats"]) == 1
    # The same action delivered again, on the same version: nothing is added or changed.
    assert run(2) == first
    assert tables.latest_version(spark, f"{root}/table") == 2
