"""Rate limits: token buckets, deferrals, timetables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    ACCOUNTS_SQL,
    AUDIT_BATCHES_SQL,
    accounts,
    audit_batches,
    table,
)
from checks.registry import query
from swathe.operators import ratelimit as rl

DAY_MS = 86_400_000


def bucket_sql(source, account, order, ids, period):
    """Decisions of a table with columns ms, amount, cap, by recursion over each account's
    requests in integer units of 1/period token."""
    return f"""(WITH RECURSIVE
    s AS (SELECT *, amount > 0 AND amount <= cap AS counted FROM {source}),
    e AS (SELECT *, row_number() OVER (PARTITION BY {account} ORDER BY {order}) AS i
          FROM s WHERE counted),
    r AS (
      SELECT {account}, i, ms, {ids}, cap, true AS allowed, amount,
             (cap - amount) * {period} AS left_units FROM e WHERE i = 1
      UNION ALL
      SELECT {account}, i, ms, {ids}, cap, avail >= amount * {period}, amount,
             CASE WHEN avail >= amount * {period} THEN avail - amount * {period} ELSE avail END
      FROM (SELECT e.*, least(e.cap * {period}, r.left_units
              + least(greatest(e.ms - r.ms, 0), {period}) * e.cap) AS avail
            FROM r JOIN e ON e.{account} = r.{account} AND e.i = r.i + 1))
    SELECT {account}, {ids}, cap, allowed,
      CASE WHEN allowed THEN 0 ELSE (amount * {period} - left_units) / CAST(cap AS DOUBLE) / 1000
        END AS retry_after_seconds,
      left_units / CAST({period} AS DOUBLE) AS tokens_remaining, false AS unsatisfiable FROM r
    UNION ALL SELECT {account}, {ids}, cap, amount <= 0, CASE WHEN amount <= 0 THEN 0 END,
      CASE WHEN amount <= 0 THEN CAST(cap AS DOUBLE) END, amount > cap FROM s WHERE NOT counted)"""


_EVENTS_SQL = "(SELECT *, epoch_us(ts) // 1000 AS ms, 1 AS amount, 3 AS cap FROM events)"
EVENT_BUCKET_SQL = bucket_sql(_EVENTS_SQL, "user_id", "ts, event_id", "event_id, ts", DAY_MS)
DECISION = ("event_id, user_id, allowed, CAST(retry_after_seconds AS DOUBLE) AS "
            "retry_after_seconds, tokens_remaining, unsatisfiable")


def event_bucket(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts").withColumns(
        {"amount": F.lit(1), "cap": F.lit(3)})
    return rl.token_bucket(events, "user_id", ["ts", "event_id"], "ts", "amount", "cap", DAY_MS)


def decisions(decided):
    return decided.select("event_id", "user_id", "allowed", "retry_after_seconds",
                          "tokens_remaining", "unsatisfiable")


@query("token_bucket", f"SELECT {DECISION} FROM {EVENT_BUCKET_SQL}")
def token_bucket(spark, sf):
    return decisions(event_bucket(spark, sf))


_ONE_SQL = "(SELECT *, epoch_us(ts) // 1000 AS ms, 1 AS amount, 2 AS cap FROM events)"


@query("submission_limit", f"""
    SELECT user_id, count(*) FILTER (allowed) AS admitted, count(*) FILTER (NOT allowed) AS denied
    FROM {bucket_sql(_ONE_SQL, 'user_id', 'ts, event_id', 'event_id, ts', DAY_MS)}
    GROUP BY user_id""")
def submission_limit(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    decided = rl.submission_limit(rows, ["ts", "event_id"], "ts", account="user_id", per_minute=2,
                                  period_ms=DAY_MS)
    return decided.groupBy("user_id").agg(
        F.count_if(F.col("allowed")).alias("admitted"),
        F.count_if(~F.col("allowed")).alias("denied"))


# Batches of the audit view ask for their entity count; limits are low enough to bind.
_LIMITS = "account_id, 1 + account_id % 4 AS rate_limit_per_minute"
_BATCHES_SQL = f"""(SELECT action_id AS account_id, batch_index, finished_at,
    epoch_us(finished_at) // 1000 AS ms, entity_count AS amount, rate_limit_per_minute AS cap
  FROM {AUDIT_BATCHES_SQL} b JOIN (SELECT {_LIMITS} FROM {ACCOUNTS_SQL}) a
    ON a.account_id = b.action_id)"""
_ADMIT_SQL = bucket_sql(_BATCHES_SQL, "account_id", "finished_at, batch_index",
                        "batch_index, finished_at", 60_000)


def _admitted(spark, sf):
    batches = audit_batches(spark, sf).withColumnRenamed("action_id", "account_id").select(
        "account_id", "batch_index", "entity_count", "finished_at")
    limits = accounts(spark, sf).selectExpr(*_LIMITS.split(", "))
    return rl.admit_batches(batches, limits, ["finished_at", "batch_index"], "finished_at")


@query("admit_batches", f"""
    SELECT account_id, batch_index, allowed, unsatisfiable,
      CAST(retry_after_seconds AS DOUBLE) AS retry_after_seconds, tokens_remaining
    FROM {_ADMIT_SQL}""")
def admit_batches(spark, sf):
    return _admitted(spark, sf).select("account_id", "batch_index", "allowed", "unsatisfiable",
                                       "retry_after_seconds", "tokens_remaining")


@query("deferrals", f"""
    SELECT account_id, batch_index, 'pending' AS status,
      CAST(floor(retry_after_seconds * 1000) AS BIGINT) + 50 AS retry_after_ms,
      finished_at + to_milliseconds(CAST(floor(retry_after_seconds * 1000) AS BIGINT) + 50)
        AS next_try_at
    FROM {_ADMIT_SQL} WHERE NOT allowed AND NOT unsatisfiable""")
def deferrals(spark, sf):
    return rl.deferrals(_admitted(spark, sf), "finished_at").select(
        "account_id", "batch_index", "status", "retry_after_ms",
        F.col("next_try_at").cast("timestamp_ntz").alias("next_try_at"))


@query("bucket_peek", f"""
    SELECT user_id, least(CAST(any_value(cap) AS DOUBLE), arg_max(tokens_remaining,
        (ts, event_id)) + greatest(epoch_us(TIMESTAMP '2024-01-30 18:00:00') // 1000
        - epoch_us(max(ts)) // 1000, 0) * CAST(3 AS DOUBLE) / {DAY_MS}) AS tokens_available
    FROM {EVENT_BUCKET_SQL} GROUP BY user_id
    UNION ALL SELECT -1 - user_id, CAST(3 AS DOUBLE) FROM {ACCOUNTS_SQL} a(user_id)""")
def bucket_peek(spark, sf):
    now = F.to_timestamp_ntz(F.lit("2024-01-30 18:00:00"))
    users = accounts(spark, sf).selectExpr("explode(array(account_id, -1 - account_id)) AS user_id",
                                           "3 AS cap")
    return rl.peek(event_bucket(spark, sf), "user_id", ["ts", "event_id"], "ts", "amount", "cap", now,
                   DAY_MS, users)


@query("admit_unknown_account", f"""
    SELECT action_id AS account_id, batch_index, action_id % 3 = 0 AS unknown_account
    FROM {AUDIT_BATCHES_SQL}""")
def admit_unknown_account(spark, sf):
    batches = audit_batches(spark, sf).withColumnRenamed("action_id", "account_id").select(
        "account_id", "batch_index", "entity_count", "finished_at")
    known = accounts(spark, sf).where("account_id % 3 <> 0")
    return rl.admit_batches(batches, known, ["finished_at", "batch_index"], "finished_at").select(
        "account_id", "batch_index", "unknown_account")


@query("admission_timetable", f"""
    SELECT account_id, batch_index, CASE WHEN amount <= cap THEN round(greatest((CAST(
        sum(CASE WHEN amount BETWEEN 1 AND cap THEN amount ELSE 0 END) OVER (
          PARTITION BY account_id ORDER BY batch_index ROWS UNBOUNDED PRECEDING) AS BIGINT) - cap)
        / (cap / CAST(60 AS DOUBLE)), 0), 6) END AS admit_after_seconds FROM {_BATCHES_SQL}""")
def admission_timetable(spark, sf):
    batches = audit_batches(spark, sf).withColumnRenamed("action_id", "account_id").select(
        "account_id", "batch_index", "entity_count")
    limited = rl.with_limits(batches, accounts(spark, sf).selectExpr(*_LIMITS.split(", ")))
    return rl.admission_timetable(limited, "account_id", ["batch_index"], "entity_count",
                                  "rate_limit_per_minute").select(
        "account_id", "batch_index",
        F.round("admit_after_seconds", 6).alias("admit_after_seconds"))
