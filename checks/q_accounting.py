"""Counters, statistics, life cycle, integrity, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    AUDIT_BATCHES_SQL,
    AUDIT_SQL,
    OPEN_BATCHES_SQL,
    SUBMISSIONS_SQL,
    audit,
    audit_batches,
    open_batches,
    submissions,
    table,
)
from checks.registry import query
from swathe.functions.measures import (
    duration_seconds,
    pending,
    per_minute,
    progress_percent,
)
from swathe.functions.text import stable_id, truncate
from swathe.model import ACTION_STATUSES, TERMINAL_STATUSES
from swathe.operators import accounting as acc
from swathe.operators import integrity

_COUNTS = """count(*) FILTER (status = 'success') AS success_count,
    count(*) FILTER (status = 'failed') AS failure_count,
    count(*) FILTER (status = 'skipped') AS skipped_count, count(*) AS processed_count"""

_COUNTERS_SQL = f"""(SELECT action_id, CAST(sum(entity_count) AS BIGINT) AS total_entities,
    CAST(sum(success_count) AS BIGINT) AS success_count,
    CAST(sum(failure_count) AS BIGINT) AS failure_count,
    CAST(sum(skipped_count) AS BIGINT) AS skipped_count,
    CAST(sum(processed_count) AS BIGINT) AS processed_count, count(*) AS total_batches,
    count(*) FILTER (status IN ('completed', 'failed')) AS completed_batches
    FROM {OPEN_BATCHES_SQL} GROUP BY action_id)"""

_STATUS_SQL = """CASE WHEN completed_batches < total_batches THEN 'processing'
    WHEN failure_count > 0 THEN 'completed_with_errors' ELSE 'completed' END"""


def _counters(spark, sf):
    return acc.action_counters(open_batches(spark, sf))


@query("batch_counts", f"""
    SELECT action_id, batch_index, {_COUNTS} FROM {AUDIT_SQL} GROUP BY action_id, batch_index""")
def batch_counts(spark, sf):
    return acc.batch_counts(audit(spark, sf), ["action_id", "batch_index"])


@query("action_counters", f"SELECT * FROM {_COUNTERS_SQL}")
def action_counters(spark, sf):
    return _counters(spark, sf)


@query("actions_total", f"""
    SELECT {_COUNTS} FROM {AUDIT_SQL}""")
def actions_total(spark, sf):
    return acc.actions_total(acc.batch_counts(audit(spark, sf), ["action_id"]))


_BREAKDOWN_SQL = f"""(SELECT action_id, status, coalesce(reason_code, 'unspecified')
    AS reason_code, count(*) AS n FROM {AUDIT_SQL} WHERE status IN ('failed', 'skipped')
    GROUP BY ALL)"""


@query("reason_breakdown", f"SELECT * FROM {_BREAKDOWN_SQL}")
def reason_breakdown(spark, sf):
    return acc.reason_breakdown(audit(spark, sf))


def _map_text(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")


def _map_sql(status):
    return (f"coalesce(string_agg(reason_code || '=' || n, ',' ORDER BY reason_code) "
            f"FILTER (status = '{status}'), '')")


@query("breakdown_map", f"""
    SELECT action_id, {_map_sql('failed')} AS failures, {_map_sql('skipped')} AS skips
    FROM {_BREAKDOWN_SQL} GROUP BY action_id""")
def breakdown_map(spark, sf):
    maps = acc.breakdown_maps(acc.reason_breakdown(audit(spark, sf)))
    return maps.select("action_id", _map_text("failure_breakdown").alias("failures"),
                       _map_text("skip_breakdown").alias("skips"))


_SPANS = """SELECT user_id AS action_id, min(ts) AS started_at,
    CASE WHEN user_id % 6 <> 0 THEN max(ts) END AS finished_at FROM {e} GROUP BY user_id"""


def _spans(spark, sf):
    return spark.sql(_SPANS, e=table(spark, sf, "events"))


_SPANS_SQL = "(" + _SPANS.format(e="events") + ")"
_SECONDS_SQL = """greatest((epoch_us(coalesce(finished_at, TIMESTAMP '2024-02-01 00:00:00'))
    - epoch_us(started_at)) / CAST(1000000 AS DOUBLE), 0)"""


@query("action_stats", f"""
    SELECT s.action_id, {_STATUS_SQL} AS status, 'event' AS entity_type, 'update' AS action_type,
      total_entities, processed_count, success_count, failure_count, skipped_count,
      greatest(total_entities - processed_count, 0) AS pending_count, total_batches,
      completed_batches, round(processed_count / CAST(total_entities AS DOUBLE) * 100, 2)
        AS progress_percent,
      round({_SECONDS_SQL}, 3) AS duration_seconds,
      CASE WHEN {_SECONDS_SQL} > 0 AND processed_count > 0
           THEN round(processed_count / {_SECONDS_SQL} * 60, 2) END AS entities_per_minute,
      failures, skips
    FROM {_SPANS_SQL} s JOIN {_COUNTERS_SQL} c USING (action_id)
    JOIN (SELECT action_id, {_map_sql('failed')} AS failures, {_map_sql('skipped')} AS skips
          FROM {_BREAKDOWN_SQL} GROUP BY action_id) USING (action_id)""")
def action_stats(spark, sf):
    actions = _spans(spark, sf).selectExpr(
        "action_id", "'event' AS entity_type", "'update' AS action_type", "started_at",
        "finished_at")
    stats = acc.action_stats(actions, _counters(spark, sf),
                             acc.reason_breakdown(audit(spark, sf)), now="2024-02-01 00:00:00")
    return stats.withColumns({
        "failures": _map_text("failure_breakdown"), "skips": _map_text("skip_breakdown"),
    }).drop("failure_breakdown", "skip_breakdown", "started_at", "finished_at")


@query("action_status", f"SELECT action_id, {_STATUS_SQL} AS status FROM {_COUNTERS_SQL}")
def action_status(spark, sf):
    return _counters(spark, sf).select("action_id", acc.final_status().alias("status"))


@query("progress_percent", f"""
    SELECT action_id, round(processed_count / CAST(total_entities AS DOUBLE) * 100, 2)
      AS progress_percent FROM {_COUNTERS_SQL}""")
def percent(spark, sf):
    return _counters(spark, sf).select(
        "action_id", progress_percent("processed_count", "total_entities")
        .alias("progress_percent"))


@query("pending", f"""
    SELECT action_id, greatest(total_entities - processed_count, 0) AS pending_count
    FROM {_COUNTERS_SQL}""")
def pending_count(spark, sf):
    return _counters(spark, sf).select(
        "action_id", pending("total_entities", "processed_count").alias("pending_count"))


@query("durations", f"""
    SELECT action_id, round({_SECONDS_SQL}, 3) AS duration_seconds FROM {_SPANS_SQL}""")
def durations(spark, sf):
    seconds = duration_seconds("started_at", "finished_at", F.lit("2024-02-01 00:00:00"))
    return _spans(spark, sf).select("action_id", F.round(seconds, 3).alias("duration_seconds"))


@query("throughput", f"""
    SELECT action_id, CASE WHEN {_SECONDS_SQL} > 0 AND n > 0
      THEN round(n / {_SECONDS_SQL} * 60, 2) END AS entities_per_minute
    FROM {_SPANS_SQL} JOIN (SELECT user_id AS action_id, count(*) AS n FROM events GROUP BY 1)
      USING (action_id)""")
def throughput(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("action_id")).agg(
        F.count("*").alias("n"))
    seconds = duration_seconds("started_at", "finished_at", F.lit("2024-02-01 00:00:00"))
    return _spans(spark, sf).join(counts, "action_id").select(
        "action_id", per_minute("n", seconds).alias("entities_per_minute"))


_TIMELINE_SQL = f"""(
  SELECT action_id, batch_index, finished_at,
    {{sums}}, count(*) OVER w AS completed_batches, total_batches, total_entities,
    round(CAST(sum(processed_count) OVER w AS DOUBLE) / total_entities * 100, 2)
      AS progress_percent,
    count(*) OVER w = total_batches AS is_last
  FROM {OPEN_BATCHES_SQL} JOIN (SELECT action_id, total_entities, total_batches
    FROM {_COUNTERS_SQL}) USING (action_id)
  WHERE finished_at IS NOT NULL
  WINDOW w AS (PARTITION BY action_id ORDER BY finished_at, batch_index
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""".format(
    sums=", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS {c}" for c in (
        "success_count", "failure_count", "skipped_count", "processed_count")))


@query("progress_timeline", f"SELECT * FROM {_TIMELINE_SQL}")
def progress_timeline(spark, sf):
    return acc.progress_timeline(open_batches(spark, sf), _counters(spark, sf))


_FINISHED_SQL = f"""
  SELECT action_id, batch_index, finished_at FROM (
    SELECT *, count(*) OVER (PARTITION BY action_id ORDER BY finished_at, batch_index
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n,
           count(*) OVER (PARTITION BY action_id) AS total FROM {AUDIT_BATCHES_SQL})
  WHERE n = total"""


@query("finishing_batch", _FINISHED_SQL)
def finishing_batch(spark, sf):
    batches = audit_batches(spark, sf)
    return acc.finishing_batches(acc.progress_timeline(batches, acc.action_counters(batches)))


@query("cancel_cut", f"""
    SELECT action_id, batch_index,
      CASE WHEN keeps THEN status ELSE 'cancelled' END AS status,
      CASE WHEN keeps THEN finished_at ELSE TIMESTAMP '2024-02-01 00:00:40' END AS finished_at,
      CASE WHEN keeps THEN processed_count ELSE 0 END AS processed_count
    FROM (SELECT *, coalesce(finished_at <= TIMESTAMP '2024-02-01 00:00:40', false) AS keeps
          FROM {OPEN_BATCHES_SQL})""")
def cancel_cut(spark, sf):
    at = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:40"))
    return acc.apply_cancellation(open_batches(spark, sf), at).select(
        "action_id", "batch_index", "status", "finished_at", "processed_count")


@query("cancellable", f"""
    SELECT action_id, {_STATUS_SQL} NOT IN ('completed', 'completed_with_errors', 'failed',
      'cancelled') AS cancellable FROM {_COUNTERS_SQL}""")
def cancellable(spark, sf):
    return _counters(spark, sf).select(
        "action_id", acc.cancellable(acc.final_status()).alias("cancellable"))


@query("failed_batch_rows", f"""
    SELECT action_id, batch_index, unnest(generate_series(1, entity_count)) AS entity_no,
      'failed' AS status, 'batch_error' AS reason_code,
      substr('Gave up after 3 attempts: ' || repeat('no space ', batch_index + 90), 1, 1000)
        AS message
    FROM {AUDIT_BATCHES_SQL} WHERE failure_count >= 1""")
def failed_batch_rows(spark, sf):
    batches = audit_batches(spark, sf)
    errors = batches.where("failure_count >= 1").selectExpr(
        "action_id", "batch_index",
        "repeat('no space ', cast(batch_index + 90 AS int)) AS error")
    return acc.failed_batch_rows(batches, errors, ["action_id", "batch_index"])


_STEPS = """SELECT user_id AS action_id, event_id,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'planning'
    WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END
    AS before_status,
  CASE event_id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed'
    WHEN 3 THEN 'planning' ELSE 'scheduled' END AS after_status FROM {e}"""


@query("transition_check", f"""
    SELECT before_status, after_status, CASE
        WHEN before_status IN ('completed', 'cancelled') THEN false
        WHEN after_status IN ('processing', 'planning')
          THEN before_status IN ('queued', 'scheduled', 'planning')
        WHEN after_status = 'completed' THEN before_status IN ('planning', 'processing')
        WHEN after_status = 'failed' THEN true ELSE false END AS allowed, count(*) AS n
    FROM ({_STEPS.format(e='events')}) GROUP BY ALL""")
def transition_check(spark, sf):
    steps = spark.sql(_STEPS, e=table(spark, sf, "events"))
    return steps.groupBy(
        "before_status", "after_status",
        acc.transition_allowed("before_status", "after_status").alias("allowed")
    ).agg(F.count("*").alias("n"))


@query("fail_actions", f"""
    SELECT action_id,
      CASE WHEN hit THEN 'failed' ELSE status END AS status,
      CASE WHEN hit THEN substr(repeat('bad plan ', 300), 1, 2000) END AS error,
      CASE WHEN hit THEN TIMESTAMP '2024-02-01 00:00:00' END AS finished_at
    FROM (SELECT action_id, {_STATUS_SQL} AS status, failure_count > 3
            AND {_STATUS_SQL} = 'processing' AS hit FROM {_COUNTERS_SQL})""")
def fail_actions(spark, sf):
    counters = _counters(spark, sf)
    actions = counters.select("action_id", acc.final_status().alias("status"),
                              F.lit(None).cast("string").alias("error"),
                              F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    failures = counters.where("failure_count > 3").selectExpr(
        "action_id", "repeat('bad plan ', 300) AS failure")
    at = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    return acc.fail_actions(actions, failures, at)


@query("attempts", """
    SELECT user_id AS action_id, event_id // 1000 AS batch_index, count(*) AS attempts
    FROM events GROUP BY ALL""")
def attempts(spark, sf):
    log = table(spark, sf, "events").selectExpr(
        "user_id AS action_id", "event_id div 1000 AS batch_index")
    return acc.attempts(log)


@query("steady_state_rate", """
    WITH s AS (SELECT user_id AS action_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t,
                      count(*) AS n FROM events GROUP BY ALL),
    c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY action_id ORDER BY t) AS BIGINT) AS done,
            row_number() OVER (PARTITION BY action_id ORDER BY t) AS i,
            count(*) OVER (PARTITION BY action_id) AS samples FROM s),
    p AS (SELECT *, lag(t) OVER w AS t0, lag(done) OVER w AS d0 FROM c
          WHERE samples >= 4 AND i > 1 AND i < samples
          WINDOW w AS (PARTITION BY action_id ORDER BY t)),
    m AS (SELECT action_id, median((done - d0) / CAST(t - t0 AS DOUBLE) * 60) AS m
          FROM p WHERE t0 IS NOT NULL GROUP BY 1)
    SELECT action_id, any_value(samples) AS samples, round(any_value(m), 9) AS per_minute
    FROM c LEFT JOIN m USING (action_id) GROUP BY 1""")
def steady_state_rate(spark, sf):
    from swathe.operators.ordered import running_sum
    hours = table(spark, sf, "events").selectExpr(
        "user_id AS action_id", "unix_seconds(cast(date_trunc('HOUR', ts) AS timestamp)) AS t"
    ).groupBy("action_id", "t").agg(F.count("*").alias("n"))
    samples = running_sum(hours, ["action_id"], ["t"], {"done": "n"})
    rates = acc.steady_state_rate(samples, ["action_id"], "t", "done")
    return rates.withColumn("per_minute", F.round("per_minute", 9))


@query("conservation", f"""
    SELECT *, success_count + failure_count + skipped_count = processed_count
      AND processed_count = total_entities AS conserved FROM {_COUNTERS_SQL}""")
def conservation(spark, sf):
    return acc.conservation(_counters(spark, sf))


@query("batch_state_counts", f"""
    SELECT status, count(*) AS n FROM {OPEN_BATCHES_SQL} GROUP BY status""")
def batch_state_counts(spark, sf):
    return acc.batch_state_counts(open_batches(spark, sf))


# --- integrity ------------------------------------------------------------------------------

@query("integrity_vocab", """
    SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders
    WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY ALL
    UNION ALL SELECT 'event_type', event_type, count(*) FROM events
    WHERE event_type NOT IN ('scheduled', 'queued', 'planning', 'processing', 'completed',
      'completed_with_errors', 'failed', 'cancelled') GROUP BY ALL""")
def integrity_vocab(spark, sf):
    a = integrity.check_vocabulary(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"])
    b = integrity.check_vocabulary(table(spark, sf, "events"), "event_type", ACTION_STATUSES)
    return (a.select(F.lit("o_orderstatus").alias("column_name"), "value", "n")
            .unionByName(b.select(F.lit("event_type").alias("column_name"), "value", "n")))


@query("integrity_unique", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL
    HAVING count(*) > 1""")
def integrity_unique(spark, sf):
    return integrity.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("integrity_unique_key", f"""
    SELECT account_id, idempotency_key, count(*) AS n FROM {SUBMISSIONS_SQL}
    WHERE idempotency_key IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def integrity_unique_key(spark, sf):
    return integrity.check_unique(submissions(spark, sf), ["account_id", "idempotency_key"])


@query("integrity_fk", """
    SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN
      (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def integrity_fk(spark, sf):
    parents = table(spark, sf, "supplier").where("s_acctbal > 0")
    return integrity.check_foreign_key(table(spark, sf, "lineitem"), "l_suppkey", parents,
                                       "s_suppkey").select("l_orderkey", "l_linenumber",
                                                           "l_suppkey")


@query("integrity_nulls", f"""
    WITH a AS (SELECT * FROM {AUDIT_SQL})
    SELECT 'status' AS column_name, count(*) FILTER (status IS NULL) AS nulls FROM a
    UNION ALL SELECT 'reason_code', count(*) FILTER (reason_code IS NULL) FROM a
    UNION ALL SELECT 'entity_id', count(*) FILTER (entity_id IS NULL) FROM a""")
def integrity_nulls(spark, sf):
    return integrity.check_not_null(audit(spark, sf), ["status", "reason_code", "entity_id"])


# --- texts ----------------------------------------------------------------------------------

@query("json_details", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
      '{"event_type":"' || event_type || '","k":' || json_extract(props, '$.k') || '}' AS details
    FROM events""")
def json_details(spark, sf):
    parsed = F.from_json("props", "struct<k:bigint>")
    return table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"),
        F.to_json(F.struct("event_type", parsed["k"].alias("k"))).alias("details"))


@query("messages", f"""
    SELECT log_id, substr(format('action {{}}: {{}} ({{}})', action_id, status,
      coalesce(reason_code, 'unspecified')), 1, 30) AS message FROM {AUDIT_SQL}""")
def messages(spark, sf):
    text = F.format_string("action %d: %s (%s)", "action_id", "status",
                           F.coalesce("reason_code", F.lit("unspecified")))
    return audit(spark, sf).select("log_id", truncate(text, 30).alias("message"))


@query("stable_ids", """
    SELECT event_id, sha256(concat_ws(chr(31), CAST(user_id AS VARCHAR), event_type,
      CAST(event_id AS VARCHAR))) AS row_id FROM events""")
def stable_ids(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", stable_id("user_id", "event_type", "event_id").alias("row_id"))


@query("terminal_actions", f"""
    SELECT count(*) FILTER (s IN ('completed', 'completed_with_errors')) AS terminal,
      count(*) AS actions FROM (SELECT {_STATUS_SQL} AS s FROM {_COUNTERS_SQL})""")
def terminal_actions(spark, sf):
    return _counters(spark, sf).agg(
        F.count_if(acc.final_status().isin(*TERMINAL_STATUSES)).alias("terminal"),
        F.count("*").alias("actions"))
