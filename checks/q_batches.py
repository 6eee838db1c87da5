"""Batch planning, de-duplication and the checks around stored plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    ACCOUNTS_SQL,
    ID_LIST_SQL,
    NOISY_PART_SQL,
    ORDERS,
    ORDERS_SQL,
    SHRUNKEN_SQL,
    SUBMISSIONS_SQL,
    accounts,
    id_list,
    noisy_part,
    orders,
    shrunken_orders,
    submissions,
    table,
)
from checks.registry import query
from swathe.functions.text import WHITESPACE, normalise_key
from swathe.operators.batching import (
    drift_rows,
    new_batches,
    plan_batches,
    plan_from_ids,
    plan_totals,
    resolve_batches,
    unfinished_batches,
)
from swathe.operators.dedup import claimed_keys, distinct_keys, mark_duplicates
from swathe.operators.submissions import with_batch_size
from swathe.operators.targets import select_targets

SIZE = 100
URGENT = "1-URGENT"
FILTER = {"o_totalprice": {"gte": 100000}}

_TARGETS_SQL = f"""(SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {SIZE}
    AS batch_index FROM {ORDERS_SQL} WHERE o_orderpriority = '{URGENT}' AND deleted_at IS NULL
    AND o_totalprice >= 100000)"""
PLAN_SQL = f"""(SELECT batch_index, min(o_orderkey) AS cursor_start,
    max(o_orderkey) AS cursor_end, count(*) AS entity_count, 'pending' AS status
    FROM {_TARGETS_SQL} GROUP BY batch_index)"""


def stored_plan(spark, sf):
    return plan_batches(select_targets(orders(spark, sf), ORDERS, URGENT, FILTER),
                        "o_orderkey", SIZE)


@query("plan_batches", f"SELECT * FROM {PLAN_SQL}")
def plan(spark, sf):
    return stored_plan(spark, sf)


@query("plan_whole_table", f"""
    SELECT batch_index, min(o_orderkey) AS cursor_start, max(o_orderkey) AS cursor_end,
           count(*) AS entity_count, 'pending' AS status
    FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_index
          FROM orders) GROUP BY batch_index""")
def plan_whole(spark, sf):
    return plan_batches(table(spark, sf, "orders"), "o_orderkey", 1000)


@query("plan_from_ids", f"""
    WITH f AS (SELECT o_orderkey, min(pos) AS pos FROM {ID_LIST_SQL} GROUP BY 1),
    b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY pos) - 1) // 50 AS batch_index FROM f)
    SELECT batch_index, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)
             AS entity_ids, min(o_orderkey) AS cursor_start, max(o_orderkey) AS cursor_end,
           count(*) AS entity_count FROM b GROUP BY 1""")
def from_ids(spark, sf):
    plan = plan_from_ids(id_list(spark, sf), "o_orderkey", 50)
    text = F.array_join(F.transform("entity_ids", lambda x: x.cast("string")), ",")
    return plan.withColumn("entity_ids", text).drop("status")


@query("plan_totals", f"""
    SELECT CAST(sum(entity_count) AS BIGINT) AS total_entities, count(*) AS total_batches
    FROM {PLAN_SQL}""")
def totals(spark, sf):
    return plan_totals(stored_plan(spark, sf))


def _action_plan(spark, sf):
    return stored_plan(spark, sf).withColumn("action_id", F.lit("a1"))


@query("replan_idempotent", f"""
    SELECT batch_index, entity_count FROM {PLAN_SQL}
    WHERE entity_count < {SIZE} OR cursor_start > 1000""")
def replan(spark, sf):
    plan = _action_plan(spark, sf)
    stored = plan.where((F.col("cursor_start") <= 1000) & (F.col("entity_count") == SIZE))
    return new_batches(plan, stored).select("batch_index", "entity_count")


@query("pending_batches", f"""
    SELECT batch_index, entity_count FROM {PLAN_SQL} WHERE batch_index % 3 <> 1""")
def pending(spark, sf):
    plan = _action_plan(spark, sf)
    completed = plan.where("batch_index % 3 = 1")
    return unfinished_batches(plan, completed).select("batch_index", "entity_count")


_RESOLVED_SQL = f"""(SELECT o_orderkey, o_orderstatus, p.batch_index
    FROM {SHRUNKEN_SQL} o JOIN {PLAN_SQL} p
      ON o.o_orderkey BETWEEN p.cursor_start AND p.cursor_end
    WHERE o_orderpriority = '{URGENT}' AND deleted_at IS NULL AND o_totalprice >= 100000)"""


def _resolved(spark, sf):
    live = select_targets(shrunken_orders(spark, sf), ORDERS, URGENT, FILTER)
    return resolve_batches(live.select("o_orderkey", "o_orderstatus"), "o_orderkey",
                           stored_plan(spark, sf))


@query("resolve_batches", f"SELECT * FROM {_RESOLVED_SQL}")
def resolve(spark, sf):
    return _resolved(spark, sf)


@query("drift_rows", f"""
    WITH live AS (SELECT batch_index, count(*) AS n FROM {_RESOLVED_SQL} GROUP BY 1),
    gone AS (SELECT p.batch_index, entity_count - coalesce(n, 0) AS missing
             FROM {PLAN_SQL} p LEFT JOIN live USING (batch_index))
    SELECT batch_index, unnest(generate_series(1, missing)) AS drift_no
    FROM gone WHERE missing > 0""")
def drift(spark, sf):
    return drift_rows(stored_plan(spark, sf), _resolved(spark, sf))


@query("effective_batch_size", f"""
    SELECT id, account_id, greatest(1, least(greatest(1, least(
        CASE WHEN batch_size = 0 THEN 1000 ELSE batch_size END, 10000)), rate_limit_per_minute))
      AS effective_batch_size
    FROM {SUBMISSIONS_SQL} s JOIN {ACCOUNTS_SQL} a USING (account_id)""")
def batch_size(spark, sf):
    return with_batch_size(submissions(spark, sf), accounts(spark, sf)).select(
        "id", "account_id", "effective_batch_size")


_STRIP = ", ".join(f"chr({ord(c)})" for c in WHITESPACE)


def _norm_sql(column):
    return f"nullif(lower(trim({column}, concat({_STRIP}))), '')"


@query("normalise_keys", f"""
    SELECT p_partkey, {_norm_sql('p_name')} AS dedup_key FROM {NOISY_PART_SQL}""")
def normalise(spark, sf):
    return noisy_part(spark, sf).select("p_partkey", normalise_key("p_name").alias("dedup_key"))


@query("normalise_texts", f"""
    SELECT doc_id, md5({_norm_sql('text')}) AS key_md5 FROM documents""")
def normalise_texts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(normalise_key("text")).alias("key_md5"))


@query("distinct_keys", f"""
    SELECT count(DISTINCT {_norm_sql('p_name')}) AS distinct_keys FROM {NOISY_PART_SQL}""")
def distinct_names(spark, sf):
    return distinct_keys(noisy_part(spark, sf), "p_name")


@query("distinct_texts", f"SELECT count(DISTINCT {_norm_sql('text')}) AS distinct_keys FROM documents")
def distinct_texts(spark, sf):
    return distinct_keys(table(spark, sf, "documents"), "text")


def _dedup_sql(source, pk, field):
    return f"""
    SELECT {pk}, dedup_key, CASE WHEN dedup_key IS NULL THEN 'missing_key'
        WHEN row_number() OVER (PARTITION BY dedup_key ORDER BY {pk}) = 1 THEN 'unique'
        ELSE 'duplicate' END AS dedup_class
    FROM (SELECT {pk}, {_norm_sql(field)} AS dedup_key FROM {source})"""


@query("dedup_partition", _dedup_sql("part", "p_partkey", "p_name"))
def dedup(spark, sf):
    return mark_duplicates(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey",
                           "p_name", ["p_partkey"]).drop("p_name")


@query("dedup_missing_pass", _dedup_sql(NOISY_PART_SQL, "p_partkey", "p_name"))
def dedup_missing(spark, sf):
    return mark_duplicates(noisy_part(spark, sf).select("p_partkey", "p_name"), "p_partkey",
                           "p_name", ["p_partkey"]).drop("p_name")


@query("dedup_documents", f"""
    SELECT doc_id, md5(dedup_key) AS key_md5, dedup_class
    FROM ({_dedup_sql('documents', 'doc_id', 'text')})""")
def dedup_documents(spark, sf):
    return mark_duplicates(table(spark, sf, "documents").select("doc_id", "text"), "doc_id",
                           "text", ["doc_id"]).select(
        "doc_id", F.md5("dedup_key").alias("key_md5"), "dedup_class")


@query("dedup_ledger_replay", f"""
    WITH k AS (SELECT p_partkey, p_size, {_norm_sql('p_name')} AS dedup_key FROM {NOISY_PART_SQL}),
    ledger AS (SELECT dedup_key, min(p_partkey) AS claimed FROM k
               WHERE p_size > 25 AND dedup_key IS NOT NULL GROUP BY 1),
    first AS (SELECT dedup_key, min(p_partkey) AS first FROM k
              WHERE dedup_key IS NOT NULL GROUP BY 1)
    SELECT p_partkey, k.dedup_key, CASE WHEN k.dedup_key IS NULL THEN 'missing_key'
        WHEN p_partkey = coalesce(claimed, first) THEN 'unique' ELSE 'duplicate' END
        AS dedup_class
    FROM k LEFT JOIN ledger USING (dedup_key) LEFT JOIN first USING (dedup_key)""")
def dedup_replay(spark, sf):
    rows = noisy_part(spark, sf).select("p_partkey", "p_name", "p_size")
    first_run = mark_duplicates(rows.where("p_size > 25"), "p_partkey", "p_name", ["p_partkey"])
    ledger = claimed_keys(first_run, "p_partkey", "a1")
    return mark_duplicates(rows, "p_partkey", "p_name", ["p_partkey"], ledger).select(
        "p_partkey", "dedup_key", "dedup_class")
