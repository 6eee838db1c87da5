"""Actions on tables: new table versions, audit rows, the whole job."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    AS_OF,
    CUSTOMER,
    CUSTOMERS_SQL,
    ID_LIST_SQL,
    ORDERS,
    ORDERS_SQL,
    PART,
    SHRUNKEN_SQL,
    SUPPLIER,
    customers,
    id_list,
    orders,
    shrunken_orders,
    table,
)
from checks.q_batches import PLAN_SQL, stored_plan
from checks.registry import query
from swathe.model import ActionSpec
from swathe.operators.mutate import apply_changes, cascade_delete
from swathe.plans.bulk import MESSAGES, numbered_outcomes, run_action

_NOW = AS_OF
URGENT = "1-URGENT"


def _run(df, entity, spec, **options):
    return run_action(df, entity, spec, _NOW, **options)


def flagship_spec(**changes):
    return ActionSpec(**{**dict(
        action="update", account=URGENT, filter={"o_totalprice": {"gte": 100000}},
        dedup_by="o_custkey", batch_size=100, params={"updates": {"o_orderstatus": "P"}},
        action_id="a1"), **changes})


def flagship(spark, sf, **changes):
    return _run(orders(spark, sf), ORDERS, flagship_spec(**changes))


# One update of an account's orders, with one row per customer, in SQL.
FLAGSHIP_SQL = f"""(
  SELECT *, CASE WHEN rn > 1 THEN 'duplicate_key' WHEN o_orderstatus = 'P' THEN 'no_change'
                 ELSE 'updated' END AS reason_code
  FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch_index,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
        FROM {ORDERS_SQL} WHERE o_orderpriority = '{URGENT}' AND deleted_at IS NULL
          AND o_totalprice >= 100000))"""

_OUTCOME_SQL = f"""(
  SELECT 'a1' AS action_id, batch_index, o_orderkey AS entity_id,
    CASE WHEN reason_code = 'updated' THEN 'success' ELSE 'skipped' END AS status, reason_code,
    CASE reason_code WHEN 'duplicate_key'
           THEN 'Another row with the same o_custkey was processed first.'
         WHEN 'no_change' THEN '{MESSAGES["no_change"]}' END AS message,
    CASE reason_code WHEN 'updated' THEN '{{"updates":{{"o_orderstatus":"P"}}}}'
         WHEN 'duplicate_key' THEN '{{"o_custkey":"' || o_custkey || '"}}' END AS details
  FROM {FLAGSHIP_SQL})"""


@query("bulk_outcomes", f"SELECT * FROM {_OUTCOME_SQL}")
def bulk_outcomes(spark, sf):
    return flagship(spark, sf).outcomes


_BATCH_COUNTS = """count(*) AS entity_count, {c}
    count(*) FILTER (reason_code = 'updated') AS success_count,
    CAST(0 AS BIGINT) AS failure_count,
    count(*) FILTER (reason_code <> 'updated') AS skipped_count,
    count(*) AS processed_count"""


@query("bulk_batches", f"""
    SELECT 'a1' AS action_id, batch_index, min(o_orderkey) AS cursor_start,
      max(o_orderkey) AS cursor_end, {_BATCH_COUNTS.format(c="'completed' AS status,")},
      CAST(NULL AS VARCHAR) AS error
    FROM {FLAGSHIP_SQL} GROUP BY batch_index""")
def bulk_batches(spark, sf):
    return flagship(spark, sf).batches


def _stats_text(stats):
    """Statistics with the breakdown maps as text."""
    def text(c):
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(
            e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return stats.select(
        *[c for c in stats.columns if "breakdown" not in c and not c.endswith("_at")],
        text("failure_breakdown").alias("failures"), text("skip_breakdown").alias("skips"))


@query("bulk_stats", f"""
    WITH r AS (SELECT reason_code, count(*) AS n FROM {FLAGSHIP_SQL}
               WHERE reason_code <> 'updated' GROUP BY 1)
    SELECT 'a1' AS action_id, 'completed' AS status, 'orders' AS entity_type,
      'update' AS action_type, count(*) AS total_entities, count(*) AS processed_count,
      count(*) FILTER (reason_code = 'updated') AS success_count,
      CAST(0 AS BIGINT) AS failure_count,
      count(*) FILTER (reason_code <> 'updated') AS skipped_count,
      CAST(0 AS BIGINT) AS pending_count,
      count(DISTINCT batch_index) AS total_batches,
      count(DISTINCT batch_index) AS completed_batches,
      CAST(100 AS DOUBLE) AS progress_percent,
      CAST(20.96 AS DOUBLE) AS duration_seconds,
      round(count(*) / CAST(20.96 AS DOUBLE) * 60, 2) AS entities_per_minute,
      '' AS failures,
      (SELECT string_agg(reason_code || '=' || n, ',' ORDER BY reason_code) FROM r) AS skips
    FROM {FLAGSHIP_SQL}""")
def bulk_stats(spark, sf):
    result = run_action(orders(spark, sf), ORDERS, flagship_spec(), _NOW,
                        started_at="2024-02-01 00:00:00", finished_at="2024-02-01 00:00:20.96")
    return _stats_text(result.stats)


@query("bulk_logs", f"""
    SELECT row_number() OVER (ORDER BY batch_index, entity_id, reason_code) AS log_id, entity_id,
           status, reason_code FROM {_OUTCOME_SQL}""")
def bulk_logs(spark, sf):
    return numbered_outcomes(flagship(spark, sf).outcomes).select(
        "log_id", "entity_id", "status", "reason_code")


@query("bulk_table", f"""
    SELECT o.o_orderkey, o.o_custkey,
      CASE WHEN f.reason_code = 'updated' THEN 'P' ELSE o.o_orderstatus END AS o_orderstatus,
      o.o_totalprice, o.o_orderdate, o.o_orderpriority, o.deleted_at,
      CASE WHEN f.reason_code = 'updated' THEN TIMESTAMP '{AS_OF}' ELSE o.updated_at END
        AS updated_at
    FROM {ORDERS_SQL} o LEFT JOIN {FLAGSHIP_SQL} f USING (o_orderkey)""")
def bulk_table(spark, sf):
    return flagship(spark, sf).table


# Drift: planned on the full table, run on what is left of it.
_DRIFT_SQL = f"""(
  WITH live AS (
    SELECT o_orderkey, o_orderstatus, p.batch_index,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
    FROM {SHRUNKEN_SQL} o JOIN {PLAN_SQL} p
      ON o.o_orderkey BETWEEN p.cursor_start AND p.cursor_end
    WHERE o_orderpriority = '{URGENT}' AND deleted_at IS NULL AND o_totalprice >= 100000),
  gone AS (SELECT p.batch_index, entity_count - coalesce(n, 0) AS missing FROM {PLAN_SQL} p
    LEFT JOIN (SELECT batch_index, count(*) AS n FROM live GROUP BY 1) USING (batch_index))
  SELECT batch_index, o_orderkey AS entity_id,
    CASE WHEN rn > 1 THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'skipped'
         ELSE 'success' END AS status,
    CASE WHEN rn > 1 THEN 'duplicate_key' WHEN o_orderstatus = 'P' THEN 'no_change'
         ELSE 'updated' END AS reason_code FROM live
  UNION ALL
  SELECT batch_index, NULL, 'skipped', 'left_target_set'
  FROM (SELECT batch_index, unnest(generate_series(1, missing)) FROM gone WHERE missing > 0))"""


@query("bulk_drift", f"SELECT * FROM {_DRIFT_SQL}")
def bulk_drift(spark, sf):
    result = _run(shrunken_orders(spark, sf), ORDERS, flagship_spec(), plan=stored_plan(spark, sf))
    return result.outcomes.select("batch_index", "entity_id", "status", "reason_code")


@query("bulk_drift_batches", f"""
    SELECT p.batch_index, cursor_start, cursor_end, entity_count, 'completed' AS status,
      count(*) FILTER (o.status = 'success') AS success_count,
      count(*) FILTER (o.status = 'skipped') AS skipped_count, count(*) AS processed_count
    FROM {PLAN_SQL} p JOIN {_DRIFT_SQL} o USING (batch_index) GROUP BY ALL""")
def bulk_drift_batches(spark, sf):
    result = _run(shrunken_orders(spark, sf), ORDERS, flagship_spec(), plan=stored_plan(spark, sf))
    return result.batches.drop("action_id", "error", "failure_count")


@query("bulk_cancelled", f"""
    SELECT batch_index, entity_count_ AS entity_count,
      CASE WHEN batch_index < 2 THEN 'completed' ELSE 'cancelled' END AS status,
      CASE WHEN batch_index < 2 THEN success ELSE 0 END AS success_count,
      CASE WHEN batch_index < 2 THEN entity_count_ ELSE 0 END AS processed_count
    FROM (SELECT batch_index, count(*) AS entity_count_,
            count(*) FILTER (reason_code = 'updated') AS success
          FROM {FLAGSHIP_SQL} GROUP BY 1)""")
def bulk_cancelled(spark, sf):
    result = _run(orders(spark, sf), ORDERS, flagship_spec(), stop_after=2)
    return result.batches.select("batch_index", "entity_count", "status", "success_count",
                                 "processed_count")


_FAILED_SQL = f"""(
  WITH t AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch_index
             FROM {ORDERS_SQL} WHERE o_orderpriority = '{URGENT}' AND deleted_at IS NULL
               AND o_totalprice >= 100000),
  bad AS (SELECT batch_index FROM t GROUP BY 1 HAVING max(o_totalprice) > 495000)
  SELECT batch_index, o_orderkey AS entity_id,
    CASE WHEN rn > 1 OR o_orderstatus = 'P' THEN 'skipped' ELSE 'success' END AS status,
    CASE WHEN rn > 1 THEN 'duplicate_key' WHEN o_orderstatus = 'P' THEN 'no_change'
         ELSE 'updated' END AS reason_code, CAST(NULL AS VARCHAR) AS failure
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM t
        WHERE batch_index NOT IN (SELECT batch_index FROM bad))
  UNION ALL
  SELECT batch_index, NULL, 'failed', 'batch_error', 'Gave up after 3 attempts: disk full'
  FROM t WHERE batch_index IN (SELECT batch_index FROM bad))"""


def _with_failures(spark, sf):
    dear = orders(spark, sf).where("o_totalprice > 495000").where(
        f"o_orderpriority = '{URGENT}' AND deleted_at IS NULL")
    from swathe.operators.batching import resolve_batches
    failed = (resolve_batches(dear.select("o_orderkey"), "o_orderkey", stored_plan(spark, sf))
              .select("batch_index").distinct().withColumn("error", F.lit("disk full")))
    return _run(orders(spark, sf), ORDERS, flagship_spec(), failed=failed)


@query("bulk_failed_batches", f"SELECT * FROM {_FAILED_SQL}")
def bulk_failed(spark, sf):
    return _with_failures(spark, sf).outcomes.select(
        "batch_index", "entity_id", "status", "reason_code",
        F.when(F.col("status") == "failed", F.col("message")).alias("failure"))


@query("bulk_failed_status", f"""
    SELECT CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'completed_with_errors'
                ELSE 'completed' END AS status, count(*) AS processed_count,
      count(*) FILTER (status = 'failed') AS failure_count FROM {_FAILED_SQL}""")
def bulk_failed_status(spark, sf):
    return _with_failures(spark, sf).stats.select("status", "processed_count", "failure_count")


_ALL_COLUMNS = ("o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, deleted_at")
_HIT = "(o_orderpriority = '3-MEDIUM' AND deleted_at IS NULL AND o_totalprice < 200000)"


def _update(spark, sf):
    return _run(orders(spark, sf), ORDERS, ActionSpec(
        "update", "3-MEDIUM", filter={"o_totalprice": {"lt": 200000}}, batch_size=500,
        params={"updates": {"o_orderstatus": "F"}}, action_id="a2"))


@query("update_table", f"""
    SELECT {_ALL_COLUMNS}, CASE WHEN {_HIT} THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN {_HIT} AND o_orderstatus IS DISTINCT FROM 'F' THEN TIMESTAMP '{AS_OF}'
           ELSE updated_at END AS updated_at FROM {ORDERS_SQL}""")
def update_table(spark, sf):
    return _update(spark, sf).table


@query("update_account_rows", f"""
    SELECT o_orderkey, CASE WHEN {_HIT} THEN 'F' ELSE o_orderstatus END AS o_orderstatus
    FROM {ORDERS_SQL} WHERE o_orderpriority = '3-MEDIUM'""")
def update_account_rows(spark, sf):
    return _update(spark, sf).account_rows.select("o_orderkey", "o_orderstatus")


@query("update_outcomes", f"""
    SELECT 'a2' AS action_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch_index,
      o_orderkey AS entity_id,
      CASE WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'success' END AS status,
      CASE WHEN o_orderstatus = 'F' THEN 'no_change' ELSE 'updated' END AS reason_code,
      CASE WHEN o_orderstatus = 'F' THEN '{MESSAGES["no_change"]}' END AS message,
      CASE WHEN o_orderstatus <> 'F' THEN '{{"updates":{{"o_orderstatus":"F"}}}}' END AS details
    FROM {ORDERS_SQL} WHERE {_HIT}""")
def update_outcomes(spark, sf):
    return _update(spark, sf).outcomes


@query("update_noop", f"""
    SELECT o_orderkey AS entity_id FROM {ORDERS_SQL}
    WHERE o_orderpriority = '5-LOW' AND deleted_at IS NULL AND o_orderdate IS NOT DISTINCT FROM
          TIMESTAMP '1998-05-05 00:00:00' AND o_orderstatus IS NOT DISTINCT FROM 'O'""")
def update_noop(spark, sf):
    """Rows that have both requested values."""
    result = _run(orders(spark, sf), ORDERS, ActionSpec(
        "update", "5-LOW", filter={}, action_id="a3",
        params={"updates": {"o_orderdate": "1998-05-05 00:00:00", "o_orderstatus": "O"}}))
    return result.outcomes.where("reason_code = 'no_change'").select("entity_id")


@query("update_noop_status", f"""
    SELECT o_orderkey AS entity_id FROM {ORDERS_SQL}
    WHERE o_orderpriority = '5-LOW' AND deleted_at IS NULL AND o_orderstatus = 'O'""")
def update_noop_status(spark, sf):
    result = _run(orders(spark, sf), ORDERS, ActionSpec(
        "update", "5-LOW", filter={}, action_id="a3",
        params={"updates": {"o_orderstatus": "O"}}))
    return result.outcomes.where("reason_code = 'no_change'").select("entity_id")


_IDS_SQL = f"""
    WITH f AS (SELECT o_orderkey, min(pos) AS pos FROM {ID_LIST_SQL} GROUP BY 1),
    b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY pos) - 1) // 50 AS batch_index FROM f),
    live AS (SELECT * FROM {ORDERS_SQL} WHERE o_orderpriority = '2-HIGH' AND deleted_at IS NULL)"""


def _ids_spec(**changes):
    return ActionSpec(**{**dict(
        action="update", account="2-HIGH", batch_size=50, dedup_by="o_custkey", action_id="a4",
        params={"updates": {"o_orderstatus": "P"}}), **changes})


@query("update_not_found", f"""{_IDS_SQL},
    hit AS (SELECT b.o_orderkey, b.batch_index, o_orderstatus,
              row_number() OVER (PARTITION BY o_custkey ORDER BY b.batch_index, b.o_orderkey) AS rn
            FROM b JOIN live USING (o_orderkey))
    SELECT b.batch_index, b.o_orderkey AS entity_id,
      CASE WHEN hit.o_orderkey IS NULL THEN 'failed' WHEN rn > 1 OR o_orderstatus = 'P'
           THEN 'skipped' ELSE 'success' END AS status,
      CASE WHEN hit.o_orderkey IS NULL THEN 'entity_not_found' WHEN rn > 1 THEN 'duplicate_key'
           WHEN o_orderstatus = 'P' THEN 'no_change' ELSE 'updated' END AS reason_code
    FROM b LEFT JOIN hit USING (o_orderkey)""")
def update_not_found(spark, sf):
    spec = _ids_spec(ids=id_list(spark, sf), report_ids=True)
    return _run(orders(spark, sf), ORDERS, spec).outcomes.select(
        "batch_index", "entity_id", "status", "reason_code")


@query("update_ids_drift", f"""{_IDS_SQL}
    SELECT b.batch_index, live.o_orderkey AS entity_id,
      CASE WHEN live.o_orderkey IS NULL OR o_orderstatus = 'P' THEN 'skipped' ELSE 'success' END
        AS status,
      CASE WHEN live.o_orderkey IS NULL THEN 'left_target_set'
           WHEN o_orderstatus = 'P' THEN 'no_change' ELSE 'updated' END AS reason_code
    FROM b LEFT JOIN live USING (o_orderkey)""")
def update_ids_drift(spark, sf):
    spec = _ids_spec(ids=id_list(spark, sf), dedup_by=None)
    return _run(orders(spark, sf), ORDERS, spec).outcomes.select(
        "batch_index", "entity_id", "status", "reason_code")


@query("update_ids_table", f"""{_IDS_SQL}
    SELECT o.o_orderkey, CASE WHEN o.o_orderkey IN (SELECT o_orderkey FROM b)
        AND o.o_orderkey IN (SELECT o_orderkey FROM live) THEN 'P' ELSE o_orderstatus END
        AS o_orderstatus FROM {ORDERS_SQL} o""")
def update_ids_table(spark, sf):
    spec = _ids_spec(ids=id_list(spark, sf), dedup_by=None)
    return _run(orders(spark, sf), ORDERS, spec).table.select("o_orderkey", "o_orderstatus")


@query("soft_delete", f"""
    SELECT {_ALL_COLUMNS.replace(', deleted_at', '')}, o_orderstatus,
      CASE WHEN deleted_at IS NULL AND o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F'
           THEN TIMESTAMP '{AS_OF}' ELSE deleted_at END AS deleted_at,
      CASE WHEN deleted_at IS NULL AND o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F'
           THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM {ORDERS_SQL}""")
def soft_delete(spark, sf):
    return _run(orders(spark, sf), ORDERS, ActionSpec(
        "delete", "4-NOT SPECIFIED", filter={"o_orderstatus": "F"})).table


@query("soft_delete_outcomes", f"""
    SELECT o_orderkey AS entity_id, 'success' AS status, 'deleted' AS reason_code,
      '{{"hard":false}}' AS details FROM {ORDERS_SQL}
    WHERE deleted_at IS NULL AND o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F'""")
def soft_delete_outcomes(spark, sf):
    return _run(orders(spark, sf), ORDERS, ActionSpec(
        "delete", "4-NOT SPECIFIED", filter={"o_orderstatus": "F"})).outcomes.select(
        "entity_id", "status", "reason_code", "details")


@query("hard_delete", "SELECT * FROM supplier WHERE NOT (s_nationkey = 7 AND s_acctbal < 5000)")
def hard_delete(spark, sf):
    return _run(table(spark, sf, "supplier"), SUPPLIER, ActionSpec(
        "delete", 7, filter={"s_acctbal": {"lt": 5000}}, params={"hard": True})).table


@query("hard_delete_dedup", """
    SELECT * FROM part WHERE NOT (p_brand = 'Brand#7' AND p_partkey IN (
      SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#7' GROUP BY p_name))""")
def hard_delete_dedup(spark, sf):
    return _run(table(spark, sf, "part"), PART, ActionSpec(
        "delete", "Brand#7", filter={}, dedup_by="p_name", params={"hard": True})).table


@query("archive", f"""
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, deleted_at,
      CASE WHEN c_nationkey = 3 AND deleted_at IS NULL THEN 'archived' ELSE c_mktsegment END
        AS c_mktsegment FROM {CUSTOMERS_SQL}""")
def archive(spark, sf):
    return _run(customers(spark, sf), CUSTOMER, ActionSpec(
        "archive", 3, filter={}, params={"column": "c_mktsegment"})).table


@query("tag", f"""
    SELECT c_custkey, CASE WHEN c_nationkey = 9 AND deleted_at IS NULL AND c_acctbal > 1000
      THEN c_name || ' [VIP]' ELSE c_name END AS c_name FROM {CUSTOMERS_SQL}""")
def tag(spark, sf):
    return _run(customers(spark, sf), CUSTOMER, ActionSpec(
        "tag", 9, filter={"c_acctbal": {"gt": 1000}},
        params={"suffix": " [VIP]", "column": "c_name"})).table.select("c_custkey", "c_name")


@query("cascade_delete", """
    WITH n AS (SELECT * FROM nation WHERE n_name <> (SELECT n_name FROM nation WHERE n_nationkey = 3)),
    c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
    o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
    SELECT 'root' AS table_name, (SELECT count(*) FROM n) AS n
    UNION ALL SELECT 'customer', (SELECT count(*) FROM c)
    UNION ALL SELECT 'orders', (SELECT count(*) FROM o)
    UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l)
    UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier
      WHERE s_nationkey IN (SELECT n_nationkey FROM n))""")
def cascade(spark, sf):
    nation = table(spark, sf, "nation")
    kept = cascade_delete(nation, "n_nationkey", nation.where("n_nationkey = 3"), [
        ("customer", table(spark, sf, "customer"), "c_nationkey", "c_custkey", "root"),
        ("orders", table(spark, sf, "orders"), "o_custkey", "o_orderkey", "customer"),
        ("lineitem", table(spark, sf, "lineitem"), "l_orderkey", None, "orders"),
        ("supplier", table(spark, sf, "supplier"), "s_nationkey", None, "root")])
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
              for name, df in kept.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("account_limit_change", """
    SELECT n_nationkey AS account_id, n_name AS name,
      CASE WHEN n_regionkey = 2 THEN CAST(5000 AS INTEGER) ELSE 60 + n_nationkey * 40 END
        AS rate_limit_per_minute FROM nation""")
def account_limit_change(spark, sf):
    nation = table(spark, sf, "nation")
    accounts = nation.selectExpr("n_nationkey AS account_id", "n_name AS name",
                                 "60 + n_nationkey * 40 AS rate_limit_per_minute")
    changes = nation.where("n_regionkey = 2").selectExpr(
        "n_nationkey AS account_id", "5000 AS rate_limit_per_minute")
    return apply_changes(accounts, changes, "account_id", ["rate_limit_per_minute"])
