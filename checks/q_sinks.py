"""What is written, written again, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import AUDIT_SQL, ORDERS, ORDERS_SQL, audit, orders, table
from checks.q_actions import _OUTCOME_SQL, FLAGSHIP_SQL, flagship, flagship_spec
from checks.q_batches import PLAN_SQL, stored_plan
from checks.registry import query
from swathe.operators.accounting import action_counters, batch_counts, final_status
from swathe.plans.bulk import numbered_outcomes
from swathe.sources import tables
from swathe.sources.staging import staging_path
from swathe.streaming import apply


@query("sink_audit", f"""
    SELECT row_number() OVER (ORDER BY batch_index, entity_id, reason_code) AS log_id, *
    FROM {_OUTCOME_SQL}""")
def sink_audit(spark, sf):
    """Audit rows of an action, written twice as after a crash."""
    path = staging_path(spark, "audit")
    rows = numbered_outcomes(flagship(spark, sf).outcomes)
    for _ in range(2):
        tables.replace_outcomes(rows, path)
    return spark.read.parquet(path).select("log_id", "action_id", "batch_index", "entity_id",
                                           "status", "reason_code", "message", "details")


@query("sink_batches", f"SELECT * FROM {PLAN_SQL}")
def sink_batches(spark, sf):
    """A plan inserted in two overlapping parts, and once more whole: batches stay as they were first
    inserted."""
    path, plan = staging_path(spark, "plan"), stored_plan(spark, sf)
    later = plan.withColumn("entity_count", F.col("entity_count") + 1)
    for part in (plan.where("batch_index % 2 = 0"), plan.where("batch_index % 2 = 1"), later):
        tables.insert_if_absent(part, path, ["batch_index"])
    return spark.read.parquet(path)


@query("sink_ledger", f"""
    SELECT 'a1' AS action_id, CAST(o_custkey AS VARCHAR) AS dedup_key, min(o_orderkey) AS winner_pk,
           true AS told FROM {FLAGSHIP_SQL} GROUP BY o_custkey""")
def sink_ledger(spark, sf):
    """Keys claimed by an action, inserted in two overlapping parts; every insert says which keys were
    new."""
    path, keys = staging_path(spark, "ledger"), flagship(spark, sf).ledger
    new = [tables.insert_if_absent(part, path, ["action_id", "dedup_key"]) for part in (
        keys.where("winner_pk % 3 <> 0"), keys.where("winner_pk % 3 <> 1"))]
    told = new[0].unionByName(new[1]).select("dedup_key", F.lit(True).alias("told"))
    return spark.read.parquet(path).join(told, "dedup_key", "left").select(
        "action_id", "dedup_key", "winner_pk", F.coalesce("told", F.lit(False)).alias("told"))


@query("sink_versions", f"""
    SELECT 'before' AS at, o_orderstatus, count(*) AS n FROM {ORDERS_SQL} GROUP BY ALL
    UNION ALL
    SELECT 'after', CASE WHEN f.reason_code = 'updated' THEN 'P' ELSE o.o_orderstatus END, count(*)
    FROM {ORDERS_SQL} o LEFT JOIN {FLAGSHIP_SQL} f ON f.o_orderkey = o.o_orderkey GROUP BY ALL""")
def sink_versions(spark, sf):
    """A table before and after an action, as two versions read back."""
    root = staging_path(spark, "versions")
    tables.write_version(orders(spark, sf), root, 1, ["o_orderpriority"])
    result = flagship(spark, sf)
    tables.write_version(result.table, root, 2, ["o_orderpriority"])

    def counts(version, name):
        return tables.read_version(spark, root, version).groupBy("o_orderstatus").agg(
            F.count("*").alias("n")).withColumn("at", F.lit(name))

    return counts(1, "before").unionByName(counts(None, "after")).select("at", "o_orderstatus", "n")


@query("sink_account", f"""
    SELECT o.o_orderkey, CASE WHEN f.reason_code = 'updated' THEN 'P' ELSE o.o_orderstatus END
      AS o_orderstatus, o.o_orderpriority
    FROM {ORDERS_SQL} o LEFT JOIN {FLAGSHIP_SQL} f ON f.o_orderkey = o.o_orderkey""")
def sink_account(spark, sf):
    """Write-back of one account's rows to a table with a folder per account."""
    path = staging_path(spark, "accounts")
    orders(spark, sf).write.partitionBy("o_orderpriority").parquet(path)
    tables.overwrite_account(flagship(spark, sf).account_rows, path, "o_orderpriority", "1-URGENT")
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("sink_submissions", """
    SELECT 'a' || s AS action_id, '1-URGENT' AS account_id, 'orders' AS entity_type,
           'update' AS action_type, 100 * s AS batch_size, 'P' AS new_status, 'o_custkey' AS dedup_by,
           min(o_orderdate) AS created_at
    FROM orders, (SELECT unnest([1, 2]) AS s) GROUP BY s""")
def sink_submissions(spark, sf):
    """Control rows of two submitted actions, with their requests as JSON."""
    path = staging_path(spark, "submissions")
    at = table(spark, sf, "orders").agg(F.min("o_orderdate")).first()[0]
    for s in (1, 2):
        tables.append_submissions(tables.submission_row(
            spark, ORDERS, flagship_spec(action_id=f"a{s}"), 100 * s, at), path)
    return spark.read.parquet(path).select(
        "action_id", "account_id", "entity_type", "action_type", "batch_size",
        F.get_json_object("configuration", "$.updates.o_orderstatus").alias("new_status"),
        F.get_json_object("configuration", "$.deduplicate_by").alias("dedup_by"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("status_of_empty_targets", f"""
    WITH a AS (SELECT DISTINCT action_id FROM {AUDIT_SQL}),
      c AS (SELECT action_id, count(*) FILTER (status = 'failed') AS failed FROM {AUDIT_SQL}
            WHERE action_id % 3 <> 0 GROUP BY 1)
    SELECT a.action_id, CASE WHEN coalesce(failed, 0) > 0 THEN 'completed_with_errors'
      ELSE 'completed' END AS status, failed IS NULL AS empty FROM a LEFT JOIN c USING (action_id)""")
def status_of_empty_targets(spark, sf):
    """An action that met nothing is complete at once; here every third one has no batch."""
    rows = audit(spark, sf)
    met = rows.where("action_id % 3 <> 0")
    batches = batch_counts(met, ["action_id", "batch_index"]).withColumns({
        "entity_count": F.col("processed_count"), "status": F.lit("completed")})
    counters = rows.select("action_id").distinct().join(action_counters(batches), "action_id", "left")
    empty = F.col("total_batches").isNull()
    zero = counters.withColumn("empty", empty).fillna(0)
    return zero.select("action_id", final_status().alias("status"), "empty")


@query("stream_redelivered", """
    SELECT event_id, user_id || '/' || event_type AS dedup_key, CASE WHEN row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'unique' ELSE 'duplicate' END
      AS dedup_class FROM events""")
def stream_redelivered(spark, sf):
    """Triggers that are delivered again, also out of turn, leave what one delivery leaves."""
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "concat(user_id, '/', event_type) AS who")
    last = rows.agg(F.max("event_id")).first()[0] + 1
    out, ledger = staging_path(spark, "again"), staging_path(spark, "again-ledger")
    step = apply.dedup_step("event_id", "who", out, ledger)
    for trigger in (0, 1, 1, 2, 3, 3):
        step(rows.where((F.col("event_id") * 4 >= trigger * last)
                        & (F.col("event_id") * 4 < (trigger + 1) * last)), trigger)
    return spark.read.parquet(out).select("event_id", "dedup_key", "dedup_class")
