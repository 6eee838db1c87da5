"""Whole actions of arriving submissions, against a statement per request in DuckDB."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import ORDERS, ORDERS_SQL, orders
from checks.q_streams import feed
from checks.registry import query
from swathe.plans.arrivals import with_changes
from swathe.sources.staging import staging_path
from swathe.streaming import apply

# What every account asks for, in order: action, configuration without the target set, target set,
# batch size. The id list holds every account's rows and one unknown key.
_IDS = "IDS"
ASKS = [
    ("update", '"updates":{"o_orderstatus":"X","o_totalprice":1.5}',
     '"filter":{"o_orderstatus":"F","o_totalprice":{"gte":100000}}', 100),
    ("update", '"updates":{"o_orderstatus":"Y"}', _IDS, 50),
    ("delete", '"hard":false', '"filter":{"o_orderdate":{"lt":"1996-01-01 00:00:00"}}', 1000),
    ("tag", '"suffix":"+","column":"o_orderstatus"',
     '"filter":{"o_orderstatus":{"in":["O","X"]}}', 500),
    ("update", '"updates":{"o_totalprice":2.5},"deduplicate_by":"o_custkey"',
     '"filter":{"o_orderstatus":{"ne":"P"}}', 200),
    ("update", '"updates":{"o_totalprice":2.5}', '"filter":{}', 300),
    ("delete", '"hard":true',
     '"filter":{"o_custkey":{"gte":20},"o_orderstatus":{"contains":"y"}}', 10),
    ("archive", '"status":"Z","column":"o_orderstatus"',
     '"filter":{"o_totalprice":{"lte":2000}}', 1000),
    ("update", '"updates":{"o_totalprice":-1}', '"filter":{}', 1000),          # refused value
    ("update", '"updates":{"o_totalprice":1}', '"filter":{"o_custkey":"many"}', 1000),
]
REFUSED = {9: "o_totalprice:below_minimum", 10: "filter:o_custkey"}


def asked(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf)
    keys = rows.where("o_orderkey % 97 = 3").agg(F.concat(
        F.lit('"entity_ids":[-5,'), F.array_join(F.array_sort(F.collect_list("o_orderkey")), ","),
        F.lit("]"))).scalar()
    accounts = rows.select("o_orderpriority").distinct()
    asks = F.array(*[F.struct(
        F.lit(k).alias("step"), F.lit(action).alias("action_type"), F.lit(size).alias("batch_size"),
        F.concat(F.lit(f"{{{params},"), keys if target is _IDS else F.lit(target), F.lit("}")).alias(
            "configuration")) for k, (action, params, target, size) in enumerate(ASKS, 1)])
    return accounts.select(F.col("o_orderpriority").alias("account_id"), F.inline(asks)).selectExpr(
        "step * 10 + cast(substr(account_id, 1, 1) AS int) AS seq",
        "concat(account_id, '/', step) AS action_id", "account_id", "action_type",
        "configuration", "batch_size", _AT)


_AT = ("TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_dt_interval(0, step, cast(substr(account_id, 1,"
       " 1) AS int)) AS created_at")


def _at(k: int) -> str:
    return (f"TIMESTAMP '2024-03-01 00:00:00' + to_hours({k}) "
            "+ to_minutes(CAST(o_orderpriority[1] AS INTEGER))")


# Per request: rows it meets, what makes a row a no-change, new values.
_STEPS = {
    1: ("o_orderstatus = 'F' AND o_totalprice >= 100000",
        "o_orderstatus = 'X' AND o_totalprice = 1.5",
        {"o_orderstatus": "'X'", "o_totalprice": "1.5"}),
    2: ("o_orderkey % 97 = 3", "o_orderstatus = 'Y'", {"o_orderstatus": "'Y'"}),
    3: ("o_orderdate < TIMESTAMP '1996-01-01 00:00:00'", "false", {"deleted_at": _at(3)}),
    4: ("o_orderstatus IN ('O', 'X')", "false", {"o_orderstatus": "o_orderstatus || '+'"}),
    5: ("o_orderstatus <> 'P'", "o_totalprice = 2.5", {"o_totalprice": "2.5"}),
    6: ("true", "o_totalprice = 2.5", {"o_totalprice": "2.5"}),
    7: ("o_custkey >= 20 AND contains(lower(o_orderstatus), 'y')", "false", {"gone": "true"}),
    8: ("o_totalprice <= 2000", "false", {"o_orderstatus": "'Z'"}),
}


def _chain() -> str:
    """CTEs r0 to r8: the rows after each request, which has its class in column c<k>."""
    parts = [f"r0 AS (SELECT *, false AS gone FROM {ORDERS_SQL})"]
    for k, (meets, same, values) in _STEPS.items():
        met = f"coalesce(NOT gone AND deleted_at IS NULL AND {meets}, false)"
        duplicate = (f"WHEN row_number() OVER (PARTITION BY {met}, o_orderpriority, o_custkey "
                     "ORDER BY o_orderkey) > 1 THEN 'duplicate'" if k == 5 else "")
        if k not in (4, 7):
            values = {**values, "updated_at": _at(k)}
        new = ", ".join(f"CASE WHEN c{k} = 'applied' THEN {v} ELSE {c} END AS {c}"
                        for c, v in values.items())
        parts.append(f"""r{k} AS (SELECT * REPLACE ({new}) FROM (
            SELECT *, CASE WHEN NOT {met} THEN NULL {duplicate}
                      WHEN {same} THEN 'no_change' ELSE 'applied' END AS c{k} FROM r{k - 1}))""")
    return ",\n".join(parts)


def _outcomes() -> str:
    reason = ("CASE c WHEN 'applied' THEN CASE WHEN k IN (3, 7) THEN 'deleted' ELSE 'updated' END "
              "WHEN 'no_change' THEN 'no_change' ELSE 'duplicate_key' END")
    parts = []
    for k in _STEPS:
        size = ASKS[k - 1][3]
        if k == 2:
            continue
        parts.append(f"""SELECT {k} AS k, o_orderpriority AS account_id, o_orderkey AS entity_id,
            c{k} AS c, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)
            // {size} AS batch_index FROM r8 WHERE c{k} IS NOT NULL""")
    lists = f"""SELECT account_id, key, (row_number() OVER (PARTITION BY account_id ORDER BY key)
        - 1) // {ASKS[1][3]} AS batch_index
        FROM (SELECT DISTINCT o_orderpriority AS account_id FROM orders),
             (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 97 = 3 UNION ALL SELECT -5)"""
    parts.append(f"""SELECT 2, l.account_id, o_orderkey, coalesce(c2, 'lost'), l.batch_index
        FROM ({lists}) l LEFT JOIN r8 ON o_orderkey = key AND o_orderpriority = l.account_id
        AND c2 IS NOT NULL""")
    return f"""o AS (SELECT account_id || '/' || k AS action_id, account_id, k, batch_index, entity_id,
        CASE c WHEN 'applied' THEN 'success' ELSE 'skipped' END AS status,
        CASE c WHEN 'lost' THEN 'left_target_set' ELSE {reason} END AS reason_code
        FROM ({' UNION ALL '.join(parts)}))"""


@cache
def _run(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Folders of what four triggers of a stream of the requests leave behind."""
    out, state = staging_path(spark, "arrivals"), staging_path(spark, "arrivals-state")
    step = apply.arrivals_step(orders(spark, sf), ORDERS, out, state)
    apply.start(feed(asked(spark, sf), "seq", "arrivals"), step,
                staging_path(spark, "offsets-arrivals"), once=True).awaitTermination()
    return out, state


@query("stream_actions", f"""WITH {_chain()}, {_outcomes()}
    SELECT action_id, account_id, batch_index, entity_id, status, reason_code FROM o""")
def stream_actions(spark, sf):
    """Audit rows of submissions that arrive on a stream: filters and ids, four actions, several
    fields, de-duplication."""
    out, _ = _run(spark, sf)
    return spark.read.parquet(f"{out}/outcomes").select(
        "action_id", "account_id", "batch_index", "entity_id", "status", "reason_code")


@query("stream_actions_table", f"""WITH {_chain()}
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
           deleted_at, updated_at FROM r8 WHERE NOT gone""")
def stream_actions_table(spark, sf):
    _, state = _run(spark, sf)
    changes = apply.arrivals_changes(spark, state, ORDERS)
    return with_changes(orders(spark, sf), ORDERS, changes).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority", "deleted_at", "updated_at")


@query("stream_actions_batches", f"""WITH {_chain()}, {_outcomes()}
    SELECT action_id, batch_index, count(*) AS entity_count,
           count(*) FILTER (status = 'success') AS success_count,
           count(*) FILTER (status = 'skipped') AS skipped_count FROM o GROUP BY 1, 2""")
def stream_actions_batches(spark, sf):
    out, _ = _run(spark, sf)
    return spark.read.parquet(f"{out}/batches").select(
        "action_id", "batch_index", "entity_count", "success_count", "skipped_count")


@query("stream_actions_stats", f"""WITH {_chain()}, {_outcomes()},
    a AS (SELECT DISTINCT o_orderpriority || '/' || k AS action_id, k
          FROM orders, (SELECT unnest(range(1, {len(_STEPS) + 1})) AS k)),
    n AS (SELECT action_id, reason_code, count(*) AS n FROM o WHERE status = 'skipped' GROUP BY ALL)
    SELECT a.action_id, 'completed' AS status, count(entity_id) + count(*) FILTER (
             o.action_id IS NOT NULL AND entity_id IS NULL) AS total_entities,
           count(*) FILTER (o.status = 'success') AS success_count,
           count(*) FILTER (o.status = 'skipped') AS skipped_count, 100.0::DOUBLE AS progress_percent,
           coalesce((SELECT '{{' || string_agg('"' || reason_code || '":' || n, ',' ORDER BY reason_code)
                     || '}}' FROM n WHERE n.action_id = a.action_id), '{{}}') AS skip_breakdown
    FROM a LEFT JOIN o ON o.action_id = a.action_id GROUP BY a.action_id""")
def stream_actions_stats(spark, sf):
    out, _ = _run(spark, sf)
    return spark.read.parquet(f"{out}/stats").select(
        "action_id", "status", "total_entities", "success_count", "skipped_count",
        "progress_percent", "skip_breakdown")


_REFUSED = ", ".join(f"({k}, '{e}')" for k, e in REFUSED.items())


@query("stream_actions_rejected", f"""
    SELECT DISTINCT o_orderpriority || '/' || k AS action_id, e AS error
    FROM orders, (VALUES {_REFUSED}) t(k, e)""")
def stream_actions_rejected(spark, sf):
    out, _ = _run(spark, sf)
    return spark.read.parquet(f"{out}/rejected").select("action_id", F.explode("errors").alias("error"))
