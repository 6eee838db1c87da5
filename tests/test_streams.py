"""Streams: progress frames, replayed triggers, idle buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import SUPPLIER, table
from swathe.operators.many import overlay
from swathe.streaming import admission, apply, progress
from tests.conftest import SF


def test_replayed_trigger_changes_nothing(spark, tmp_path):
    """Triggers 0, 1, 2, 2, 3: the third is delivered twice, as after a crash."""
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    events = table(spark, SF, "events").selectExpr(
        "event_id", "concat(user_id, '/', event_type) AS who")
    step = apply.dedup_step("event_id", "who", out, ledger)
    n = events.count()
    for trigger in (0, 1, 2, 2, 3):
        lo, hi = trigger * n // 4, (trigger + 1) * n // 4
        step(events.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)), trigger)
    rows = spark.read.parquet(out)
    assert rows.count() == n
    winners = {r.dedup_key: r.event_id for r in rows.where("dedup_class = 'unique'").collect()}
    want = {r.who: r.first for r in events.groupBy("who").agg(
        F.min("event_id").alias("first")).collect()}
    assert winners == want
    assert {r.dedup_key: r.winner_pk for r in spark.read.parquet(ledger).collect()} == want


def test_replayed_apply_trigger(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    asked = table(spark, SF, "events").selectExpr(
        "event_id AS action_id", "user_id % 25 AS account_id", "ts AS created_at",
        "event_type AS new_value")
    suppliers = table(spark, SF, "supplier")
    step = apply.apply_step(suppliers, SUPPLIER, "s_name", out, state)
    for trigger in (0, 1, 1, 2):
        step(asked.where(f"action_id div 400 = {trigger}"), trigger)
    rows = spark.read.parquet(out)
    pairs = suppliers.join(asked, F.col("s_nationkey") == F.col("account_id"))
    assert rows.count() == pairs.count()
    last = {r.s_suppkey: r.v for r in pairs.groupBy("s_suppkey").agg(
        F.max_by("new_value", "created_at").alias("v")).collect()}
    now = overlay(suppliers, SUPPLIER, "s_name", apply.earlier(spark, state, 3, newest_only=True))
    for r in now.collect():
        old = f"Supplier#{r.s_suppkey:09d}"
        assert r.s_name == last.get(r.s_suppkey, old)


def test_progress_frames_end_with_a_terminal_state(spark, tmp_path):
    source, frames = str(tmp_path / "log"), str(tmp_path / "frames")
    rows = spark.range(30).selectExpr("'x' AS action_id", "id div 10 AS batch_index",
                                      "if(id = 7, 'failed', 'success') AS status")
    totals = spark.createDataFrame([("x", 30)], "action_id string, total_entities bigint")
    states = []
    for batch in range(3):
        rows.where(f"batch_index = {batch}").write.mode("append").parquet(source)
        live = progress.progress_stream(
            progress.outcome_stream(spark, source, rows.schema), totals)
        progress.start_progress(live, frames, str(tmp_path / "offsets"), once=True
                                ).awaitTermination()
        states.append(progress.latest_progress(spark.read.parquet(frames)).first())
    assert [s.processed_count for s in states] == [10, 20, 30]
    assert [s.is_terminal for s in states] == [False, False, True]
    assert states[-1].status == "completed_with_errors" and states[0].progress_percent == 33.33


def test_audit_rows_of_a_trigger_are_written_once(spark, tmp_path, monkeypatch):
    def refuse(rows, name):
        raise AssertionError(f"{name} staged besides the rows in their own folder")

    monkeypatch.setattr(apply, "stage", refuse)
    asked = spark.createDataFrame([(1, 7, 0, "x"), (2, 7, 1, "x")],
                                  "action_id long, account_id int, created_at int, new_value string")
    suppliers = spark.createDataFrame([(5, "a", 7, 1.0)], "s_suppkey long, s_name string, "
                                      "s_nationkey int, s_acctbal double")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    step = apply.apply_step(suppliers, SUPPLIER, "s_name", out, state)
    step(asked, 0)
    step(asked, 0)
    assert sorted((r.action_id, r.status) for r in spark.read.parquet(out).collect()) == [
        (1, "success"), (2, "skipped")]
    assert [r.new_value for r in spark.read.parquet(state).collect()] == ["x"]


def test_keys_are_handed_to_python_by_slots(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, None if i % 7 == 0 else i % 50, str(i % 3)) for i in range(200)],
        "id long, who long, key string").withColumn("at", F.timestamp_seconds("id"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    firsts = admission.idempotent_stream(stream, ["who", "key"], "at")
    decided = admission.token_bucket_stream(
        stream.withColumns({"n": F.lit(1), "cap": F.lit(2)}), "who", ["id"], "at", "n", "cap")
    for name, live in (("firsts", firsts), ("decided", decided)):
        plan = live._jdf.queryExecution().analyzed().toString()
        assert "_slot#" in plan[plan.index("FlatMapGroupsInPandasWithState"):].splitlines()[0]
        (live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"o-{name}"))
         .trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination())
    want = {r.i for r in rows.groupBy("who", "key").agg(F.min("id").alias("i")).collect()}
    assert {r.id for r in spark.read.parquet(str(tmp_path / "firsts")).collect()} == want
    out = spark.read.parquet(str(tmp_path / "decided"))
    assert out.count() == 200 and {r.who for r in out.collect()} == {None, *range(50)}
