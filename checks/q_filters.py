"""Filters, target selection, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    ACCOUNTS_SQL,
    AUDIT_SQL,
    CUSTOMER,
    CUSTOMERS_SQL,
    ID_LIST_SQL,
    ORDERS,
    ORDERS_RAW,
    ORDERS_SQL,
    PART,
    SUBMISSIONS_SQL,
    accounts,
    audit,
    customers,
    id_list,
    orders,
    submissions,
    table,
)
from checks.registry import query
from swathe.functions.predicates import compile_filter
from swathe.operators.batching import plan_batches
from swathe.operators.paging import (
    action_filter,
    keyset_page,
    log_filter,
    newest_first,
    offset_page,
)
from swathe.sources.tables import account
from swathe.operators.targets import (
    id_range,
    list_entities,
    select_by_ids,
    select_targets,
)

_COLUMNS = "o_orderkey, o_orderstatus, o_totalprice, o_custkey"


def _filter_query(name, filters, where):
    @query(name, f"SELECT {_COLUMNS} FROM {ORDERS_SQL} WHERE {where}")
    def run(spark, sf):
        df = orders(spark, sf)
        return df.where(compile_filter(ORDERS_RAW, filters, df)).select(*_COLUMNS.split(", "))


@query("filter_big_ints", """
    SELECT o_orderkey FROM orders WHERE 9007199254740992 + o_orderkey = 9007199254740999
      OR 9007199254740992 + o_orderkey NOT BETWEEN 9007199254740992 + 11 AND 9007199254741501
      AND 9007199254740992 + o_orderkey <> 9007199254740993""")
def filter_big_ints(spark, sf):
    """Keys beyond 2^53, where neighbours share a double."""
    base = 2**53
    df = orders(spark, sf).withColumn("o_custkey", F.lit(base) + F.col("o_orderkey"))
    spec = {"eq": {"eq": base + 7}, "low": {"lt": base + 11, "ne": base + 1},
            "high": {"gt": str(base + 509), "not_in": [base + 1]}}
    eq, low, high = (compile_filter(ORDERS_RAW, {"o_custkey": c}, df) for c in spec.values())
    return df.where(eq | low | high).select("o_orderkey")


@query("filter_zoned_times", f"""
    SELECT o_orderkey FROM {ORDERS_SQL} WHERE o_orderdate >= TIMESTAMP '1995-12-31 22:00:00'
      AND o_orderdate < TIMESTAMP '1997-01-01 05:30:00'""")
def filter_zoned_times(spark, sf):
    df = orders(spark, sf)
    return df.where(compile_filter(ORDERS_RAW, {"o_orderdate": {
        "gte": "1996-01-01T00:00:00+02:00", "lt": "1997-01-01T00:00:00-05:30"}}, df)
        ).select("o_orderkey")


for _name, _filters, _where in [
    ("filter_eq", {"o_orderstatus": {"eq": "P"}}, "o_orderstatus = 'P'"),
    ("filter_shorthand", {"o_orderstatus": "F", "o_custkey": "77"},
     "o_orderstatus = 'F' AND o_custkey = 77"),
    ("filter_ne", {"o_orderstatus": {"ne": "P"}}, "o_orderstatus <> 'P'"),
    ("filter_gt", {"o_totalprice": {"gt": 250000}}, "o_totalprice > 250000"),
    ("filter_gte", {"o_custkey": {"gte": 700}}, "o_custkey >= 700"),
    ("filter_lt", {"o_custkey": {"lt": 100.5}}, "o_custkey < 100.5"),
    ("filter_lte", {"o_orderdate": {"lte": "1996-12-31T00:00:00"}},
     "o_orderdate <= TIMESTAMP '1996-12-31 00:00:00'"),
    ("filter_in", {"o_orderstatus": {"in": ["F", "P"]}}, "o_orderstatus IN ('F', 'P')"),
    ("filter_not_in", {"deleted_at": {"not_in": ["2024-01-02 00:00:00"]}},
     "deleted_at NOT IN (TIMESTAMP '2024-01-02 00:00:00')"),
    ("filter_is_null", {"deleted_at": {"is_null": False}}, "deleted_at IS NOT NULL"),
    ("filter_null_shorthand", {"deleted_at": None}, "deleted_at IS NULL"),
    ("filter_ne_null", {"deleted_at": {"ne": None}}, "deleted_at IS NOT NULL"),
    ("filter_conjunction", {"o_totalprice": {"gte": 100000, "lt": 300000}, "o_orderstatus": "O"},
     "o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus = 'O'"),
    ("filter_empty", {}, "true"),
]:
    _filter_query(_name, _filters, _where)


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def filter_contains(spark, sf):
    df = table(spark, sf, "part")
    return df.where(compile_filter(PART, {"p_name": {"contains": "RinG"}}, df)).select(
        "p_partkey", "p_name")


@query("select_targets", f"""
    SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey, o_orderdate, deleted_at
    FROM {ORDERS_SQL} WHERE o_orderpriority = '1-URGENT' AND deleted_at IS NULL
      AND o_totalprice >= 100000""")
def targets(spark, sf):
    return select_targets(orders(spark, sf), ORDERS, "1-URGENT",
                          {"o_totalprice": {"gte": 100000}})


@query("select_by_ids", f"""
    SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey, o_orderdate, deleted_at
    FROM {ORDERS_SQL} WHERE o_orderpriority = '2-HIGH' AND deleted_at IS NULL
      AND o_orderkey IN (SELECT o_orderkey FROM {ID_LIST_SQL})""")
def by_ids(spark, sf):
    return select_by_ids(orders(spark, sf), ORDERS, "2-HIGH", id_list(spark, sf))


@query("select_id_range", f"""
    SELECT {_COLUMNS} FROM orders WHERE o_orderkey BETWEEN 100 AND 899""")
def ranged(spark, sf):
    return id_range(table(spark, sf, "orders"), "o_orderkey", 100, 899).select(
        *_COLUMNS.split(", "))


@query("entities_page", f"""
    WITH f AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, deleted_at FROM {CUSTOMERS_SQL}
               WHERE c_mktsegment = 'BUILDING' AND deleted_at IS NULL)
    SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 35 AS has_more
    FROM f ORDER BY c_custkey LIMIT 25 OFFSET 10""")
def entities_page(spark, sf):
    rows = list_entities(customers(spark, sf), CUSTOMER, status="BUILDING",
                         status_column="c_mktsegment")
    return offset_page(rows, ["c_custkey"], 25, 10)


@query("entities_of_account", f"""
    SELECT c_custkey, c_name, c_acctbal, c_mktsegment, deleted_at FROM {CUSTOMERS_SQL}
    WHERE c_nationkey = 7""")
def entities_of_account(spark, sf):
    return list_entities(customers(spark, sf), CUSTOMER, account=7, include_deleted=True)


@query("actions_page", f"""
    WITH f AS (SELECT id, account_id, created_at, idempotency_key FROM {SUBMISSIONS_SQL}
               WHERE idempotency_key = 'purchase')
    SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 100 AS has_more
    FROM f ORDER BY created_at DESC, id LIMIT 50 OFFSET 50""")
def actions_page(spark, sf):
    rows = submissions(spark, sf).select("id", "account_id", "created_at", "idempotency_key")
    rows = rows.where(F.col("idempotency_key") == "purchase")
    return offset_page(rows, newest_first(rows, "created_at", "id"), 50, 50)


@query("actions_of_account", f"""
    SELECT id, account_id, status FROM (
      SELECT id, account_id, CASE WHEN scheduled_at IS NULL THEN 'queued' ELSE 'scheduled' END
        AS status FROM {SUBMISSIONS_SQL})
    WHERE account_id = 12 AND status = 'scheduled'""")
def actions_of_account(spark, sf):
    rows = submissions(spark, sf).select(
        "id", "account_id", F.when(F.col("scheduled_at").isNull(), "queued")
        .otherwise("scheduled").alias("status"))
    return action_filter(rows, account_id=12, status="scheduled")


@query("accounts_recent", f"""
    SELECT a.account_id, rate_limit_per_minute, first_seen
    FROM {ACCOUNTS_SQL} a JOIN (SELECT user_id, min(ts) AS first_seen FROM events GROUP BY 1) e
      ON e.user_id = a.account_id
    ORDER BY first_seen DESC, a.account_id LIMIT 50""")
def accounts_recent(spark, sf):
    seen = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    rows = accounts(spark, sf).join(seen, F.col("account_id") == F.col("user_id")).select(
        "account_id", "rate_limit_per_minute", "first_seen")
    return rows.orderBy(*newest_first(rows, "first_seen", "account_id")).limit(50)


@query("account_lookup", f"""
    SELECT account_id, rate_limit_per_minute, name FROM {ACCOUNTS_SQL} WHERE account_id = 42""")
def account_lookup(spark, sf):
    return account(accounts(spark, sf), 42)


@query("batches_page", f"""
    WITH t AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100
                 AS batch_index FROM {ORDERS_SQL}
               WHERE o_orderpriority = '1-URGENT' AND deleted_at IS NULL)
    SELECT batch_index, min(o_orderkey) AS cursor_start, max(o_orderkey) AS cursor_end,
           count(*) AS entity_count, 'pending' AS status,
           (SELECT max(batch_index) + 1 FROM t) AS total,
           (SELECT max(batch_index) + 1 FROM t) > 8 AS has_more
    FROM t GROUP BY 1 ORDER BY 1 LIMIT 5 OFFSET 3""")
def batches_page(spark, sf):
    plan = plan_batches(select_targets(orders(spark, sf), ORDERS, "1-URGENT"), "o_orderkey", 100)
    return offset_page(plan, ["batch_index"], 5, 3)


_LOGS = "log_id, action_id, batch_index, entity_id, status, reason_code"


def _logs_sql(where, cursor, limit):
    return f"""
    WITH f AS (SELECT {_LOGS} FROM {AUDIT_SQL} WHERE {where} AND log_id > {cursor}
               ORDER BY log_id LIMIT {limit + 1}),
    n AS (SELECT *, row_number() OVER (ORDER BY log_id) AS n, count(*) OVER () AS c FROM f)
    SELECT {_LOGS}, c > {limit} AS has_more,
      CASE WHEN c > {limit} THEN (SELECT max(log_id) FROM n WHERE n <= {limit}) END AS next_cursor
    FROM n WHERE n <= {limit}"""


@query("logs_page1", _logs_sql("action_id = 5", -1, 20))
def logs_page1(spark, sf):
    return keyset_page(log_filter(audit(spark, sf), action_id=5).select(*_LOGS.split(", ")),
                       "log_id", 20)


@query("logs_page2", _logs_sql("action_id = 5 AND status = 'skipped'", 700, 100))
def logs_page2(spark, sf):
    rows = log_filter(audit(spark, sf), action_id=5, status="skipped")
    return keyset_page(rows.select(*_LOGS.split(", ")), "log_id", 100, cursor=700)


@query("logs_filtered", f"""
    SELECT {_LOGS} FROM {AUDIT_SQL}
    WHERE status = 'failed' AND reason_code = 'batch_error' AND entity_id = 17""")
def logs_filtered(spark, sf):
    return log_filter(audit(spark, sf), status="failed", reason_code="batch_error", entity_id=17
                      ).select(*_LOGS.split(", "))
