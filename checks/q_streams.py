"""Streams over the test tables, worked off to the end, against their batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import (
    ACCOUNTS_SQL,
    AUDIT_SQL,
    SUBMISSIONS_SQL,
    SUPPLIER,
    accounts,
    audit,
    submissions,
    table,
)
from checks.q_admission import DAY_MS, DECISION, EVENT_BUCKET_SQL, bucket_sql, decisions
from checks.registry import query
from swathe.operators.many import outcome_counts, overlay
from swathe.sources.staging import staging_path
from swathe.streaming import admission, apply, progress

SLICES = 4


def feed(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` as a file stream that delivers it in ``order``, in four triggers."""
    spark = df.sparkSession
    path = staging_path(spark, f"feed-{name}")
    bounds = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = (bounds["hi"] - bounds["lo"]) // SLICES + 1
    for i in range(SLICES):
        low = bounds["lo"] + i * width
        (df.where((F.col(order) >= low) & (F.col(order) < low + width)).coalesce(1)
         .write.mode("append").parquet(path))
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", "*.parquet").parquet(path))


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All rows an append-mode stream produces, by way of files."""
    out = staging_path(spark, f"sink-{name}")
    (stream.writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", staging_path(spark, f"offsets-{name}"))
     .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


def _utc(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need instants; the tables hold zone-less UTC times."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


@query("stream_progress", f"""
    WITH c AS (SELECT action_id, count(*) AS processed_count,
        count(*) FILTER (status = 'success') AS success_count,
        count(*) FILTER (status = 'failed') AS failure_count,
        count(*) FILTER (status = 'skipped') AS skipped_count,
        count(*) + action_id % 2 AS total_entities FROM {AUDIT_SQL} GROUP BY action_id)
    SELECT action_id, CASE WHEN processed_count < total_entities THEN 'processing'
        WHEN failure_count > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status,
      total_entities, processed_count, success_count, failure_count, skipped_count,
      round(processed_count / CAST(total_entities AS DOUBLE) * 100, 2) AS progress_percent,
      processed_count >= total_entities AS is_terminal FROM c""")
def stream_progress(spark, sf):
    rows = audit(spark, sf)
    totals = rows.groupBy("action_id").agg(
        (F.count("*") + F.col("action_id") % 2).alias("total_entities"))
    live = progress.progress_stream(feed(rows, "log_id", "progress"), totals)
    frames = staging_path(spark, "frames")
    progress.start_progress(live, frames, staging_path(spark, "offsets-progress"), once=True
                            ).awaitTermination()
    return progress.latest_progress(spark.read.parquet(frames))


# Keys of which some are missing, some empty.
_KEY = ("CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN '' ELSE idempotency_key END")


@query("stream_idempotent", f"""
    WITH s AS (SELECT id, account_id, {_KEY} AS idempotency_key FROM {SUBMISSIONS_SQL})
    SELECT id, account_id, idempotency_key FROM s WHERE coalesce(idempotency_key, '') = ''
    UNION ALL SELECT min(id), account_id, idempotency_key FROM s
    WHERE idempotency_key <> '' GROUP BY 2, 3""")
def stream_idempotent(spark, sf):
    # Every trigger's submissions were created months before those of the trigger before it.
    rows = _utc(submissions(spark, sf), "created_at")
    width = rows.agg(F.max("id")).first()[0] // SLICES + 1
    rows = rows.selectExpr("id", "account_id", f"{_KEY} AS idempotency_key",
                           f"timestamp_millis(id) - make_dt_interval(90 * (id div {width})) AS at")
    firsts = admission.idempotent_stream(feed(rows, "id", "idempotent"),
                                         ["account_id", "idempotency_key"], "at")
    return drain(spark, firsts, "idempotent").select("id", "account_id", "idempotency_key")


# Half of the requests come ninety days late. A bucket's time is the newest that it has seen.
_LATE_MS = "epoch_us(ts) // 1000 - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 7776000000 END"
_SLICE = f"""(event_id - (SELECT min(event_id) FROM events))
    // ((SELECT max(event_id) - min(event_id) FROM events) // {SLICES} + 1)"""
_LATE_SQL = f"""(SELECT *, max(late_ms) OVER (PARTITION BY user_id ORDER BY slice, late_ms, event_id
      ROWS UNBOUNDED PRECEDING) AS ms, 1 AS amount, 2 AS cap
    FROM (SELECT event_id, user_id, {_LATE_MS} AS late_ms, {_SLICE} AS slice FROM events))"""
LATE_BUCKET_SQL = bucket_sql(_LATE_SQL, "user_id", "slice, late_ms, event_id", "event_id", DAY_MS)


def _late(spark, sf):
    return _utc(table(spark, sf, "events").select("event_id", "user_id", "ts"), "ts").withColumns(
        {"ts": F.expr("if(event_id % 2 = 0, ts, ts - INTERVAL 90 DAYS)"),
         "amount": F.lit(1), "cap": F.lit(2)})


@query("stream_late_requests", f"SELECT {DECISION} FROM {LATE_BUCKET_SQL}")
def stream_late_requests(spark, sf):
    """Late requests meet their bucket as it is; they neither refill it nor turn its time back."""
    decided = admission.token_bucket_stream(feed(_late(spark, sf), "event_id", "late"), "user_id",
                                            ["event_id"], "ts", "amount", "cap", DAY_MS)
    return decisions(drain(spark, decided, "late"))


@query("stream_late_steps", f"SELECT {DECISION} FROM {LATE_BUCKET_SQL}")
def stream_late_steps(spark, sf):
    """The same by the parallel form, whose levels outlive idle months."""
    out, state = staging_path(spark, "late"), staging_path(spark, "late-levels")
    step = admission.bucket_step("user_id", ["event_id"], "ts", "amount", "cap", out, state, DAY_MS)
    apply.start(feed(_late(spark, sf), "event_id", "late-steps"), step,
                staging_path(spark, "offsets-late"), once=True).awaitTermination()
    return decisions(spark.read.parquet(out))


@query("stream_limits_join", f"""
    SELECT event_id, account_id, rate_limit_per_minute
    FROM events JOIN {ACCOUNTS_SQL} ON account_id = user_id""")
def stream_limits_join(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "user_id AS account_id")
    joined = admission.limits_join(feed(rows, "event_id", "limits"), accounts(spark, sf))
    return drain(spark, joined, "limits").select("event_id", "account_id", "rate_limit_per_minute")


@query("stream_token_bucket", f"SELECT {DECISION} FROM {EVENT_BUCKET_SQL}")
def stream_token_bucket(spark, sf):
    rows = _utc(table(spark, sf, "events").select("event_id", "user_id", "ts"), "ts").withColumns(
        {"amount": F.lit(1), "cap": F.lit(3)})
    decided = admission.token_bucket_stream(feed(rows, "event_id", "bucket"), "user_id",
                                            ["event_id"], "ts", "amount", "cap", DAY_MS)
    return decisions(drain(spark, decided, "bucket"))


@query("stream_bucket_steps", f"SELECT {DECISION} FROM {EVENT_BUCKET_SQL}")
def stream_bucket_steps(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts").withColumns(
        {"amount": F.lit(1), "cap": F.lit(3)})
    out, state = staging_path(spark, "admitted"), staging_path(spark, "levels")
    step = admission.bucket_step("user_id", ["event_id"], "ts", "amount", "cap", out, state,
                                 DAY_MS)
    apply.start(feed(rows, "event_id", "steps"), step, staging_path(spark, "offsets-steps"),
                once=True).awaitTermination()
    return decisions(spark.read.parquet(out))


@query("stream_dedup", """
    SELECT event_id, user_id || '/' || event_type AS dedup_key, CASE WHEN row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'unique' ELSE 'duplicate' END
      AS dedup_class FROM events""")
def stream_dedup(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "concat(user_id, '/', event_type) AS who")
    out, ledger = staging_path(spark, "dedup"), staging_path(spark, "ledger")
    step = apply.dedup_step("event_id", "who", out, ledger)
    apply.start(feed(rows, "event_id", "dedup"), step, staging_path(spark, "offsets-dedup"),
                once=True).awaitTermination()
    return spark.read.parquet(out).select("event_id", "dedup_key", "dedup_class")


# Every event asks to set the name of all its nation's suppliers above a balance.
_ASKED = """event_id AS action_id, user_id % 25 AS account_id, ts AS created_at,
    event_type AS new_value, value * 20 AS least_balance"""


@query("stream_apply", f"""
    WITH hits AS (SELECT action_id, s_suppkey AS entity_id, new_value,
        coalesce(lag(new_value) OVER (PARTITION BY s_suppkey ORDER BY created_at, action_id),
                 s_name) AS before
      FROM supplier JOIN (SELECT {_ASKED} FROM events)
        ON account_id = s_nationkey AND s_acctbal >= least_balance)
    SELECT action_id, entity_id, new_value,
      CASE WHEN before = new_value THEN 'skipped' ELSE 'success' END AS status,
      CASE WHEN before = new_value THEN 'no_change' ELSE 'updated' END AS reason_code
    FROM hits""")
def stream_apply(spark, sf):
    out, _, _ = _applied(spark, sf)
    return spark.read.parquet(out).select("action_id", "entity_id", "new_value", "status",
                                          "reason_code")


@query("stream_apply_table", f"""
    SELECT s_suppkey, coalesce(last_value, s_name) AS s_name, s_nationkey
    FROM supplier LEFT JOIN (
      SELECT s_suppkey, arg_max(new_value, (created_at, action_id)) AS last_value
      FROM supplier JOIN (SELECT {_ASKED} FROM events)
        ON account_id = s_nationkey AND s_acctbal >= least_balance GROUP BY 1)
      USING (s_suppkey)""")
def stream_apply_table(spark, sf):
    _, state, suppliers = _applied(spark, sf)
    values = apply.earlier(spark, state, newest_only=True)
    return overlay(suppliers, SUPPLIER, "s_name", values).select(
        "s_suppkey", "s_name", "s_nationkey")


def _applied(spark, sf):
    asked = table(spark, sf, "events").selectExpr(*[c.strip() for c in _ASKED.split(",")])
    suppliers = table(spark, sf, "supplier")
    out, state = staging_path(spark, "applied"), staging_path(spark, "state")
    step = apply.apply_step(suppliers, SUPPLIER, "s_name", out, state,
                            matches=F.col("s_acctbal") >= F.col("least_balance"))
    apply.start(feed(asked, "action_id", "apply"), step, staging_path(spark, "offsets-apply"),
                once=True).awaitTermination()
    return out, state, suppliers


@query("many_updates", f"""
    WITH hits AS (SELECT action_id, s_suppkey AS entity_id, new_value,
        coalesce(lag(new_value) OVER (PARTITION BY s_suppkey ORDER BY created_at, action_id),
                 s_name) AS before
      FROM supplier JOIN (SELECT {_ASKED} FROM events) ON account_id = s_nationkey)
    SELECT status, reason_code, count(*) AS n FROM (
      SELECT CASE WHEN before = new_value THEN 'skipped' ELSE 'success' END AS status,
        CASE WHEN before = new_value THEN 'no_change' ELSE 'updated' END AS reason_code FROM hits)
    GROUP BY ALL""")
def many_updates(spark, sf):
    asked = table(spark, sf, "events").selectExpr(*[c.strip() for c in _ASKED.split(",")])
    return outcome_counts(table(spark, sf, "supplier"), SUPPLIER, asked, "s_name")
