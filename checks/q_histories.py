"""Removals along a graph of references, histories of statuses, pages at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.fixtures import ORDERS_SQL, orders, table
from checks.registry import query
from swathe.operators.lifecycle import final_statuses, fold_statuses
from swathe.operators.mutate import Reference, cascade
from swathe.operators.paging import Pages, newest_first

# Accounts have actions, some copied from another; actions have batches; audit rows hang on an
# action and on a batch, which may be another action's.
_ACTIONS = ("SELECT DISTINCT user_id AS action_id, user_id % 10 AS account_id, "
            "CASE WHEN user_id % 3 = 0 THEN user_id {div} 2 END AS copied_from FROM {e}")
_PARTS = ("SELECT DISTINCT user_id * 1000 + event_id % 4 AS batch_id, user_id AS action_id "
          "FROM {e}")
_LOGS = ("SELECT event_id AS log_id, user_id AS action_id, "
         "CASE WHEN event_id % 11 = 0 THEN NULL ELSE (user_id + event_id % 2) * 1000 "
         "+ event_id % 4 END AS batch_id, (event_id * 7) % 100 AS reviewer FROM {e}")


@query("cascade_graph", f"""
    WITH RECURSIVE a AS ({_ACTIONS.format(div="//", e="events")}),
      b AS ({_PARTS.format(e="events")}), l AS ({_LOGS.format(e="events")}),
      gone AS (SELECT action_id FROM a WHERE account_id = 3
               UNION SELECT a.action_id FROM a JOIN gone g ON a.copied_from = g.action_id),
      gone_b AS (SELECT batch_id FROM b WHERE batch_id % 1000 = 2 OR action_id IN (FROM gone)),
      kept_l AS (SELECT * FROM l WHERE action_id NOT IN (FROM gone)
                 AND (batch_id IS NULL OR batch_id NOT IN (FROM gone_b)))
    SELECT 'accounts' AS name, account_id AS id, NULL::BIGINT AS reviewer
    FROM (SELECT DISTINCT account_id FROM a) WHERE account_id <> 3
    UNION ALL SELECT 'actions', action_id, NULL FROM a WHERE action_id NOT IN (FROM gone)
    UNION ALL SELECT 'batches', batch_id, NULL FROM b WHERE batch_id NOT IN (FROM gone_b)
    UNION ALL SELECT 'logs', log_id, CASE WHEN reviewer <> 3 THEN reviewer END FROM kept_l""")
def cascade_graph(spark, sf):
    """An account goes, and some batches: two parents, a table that refers to itself, and a column
    that is emptied."""
    events = table(spark, sf, "events")
    actions = spark.sql(_ACTIONS.format(div="div", e="{e}"), e=events)
    tables = {"accounts": actions.select("account_id").distinct(), "actions": actions,
              "batches": spark.sql(_PARTS, e=events), "logs": spark.sql(_LOGS, e=events)}
    batches = tables["batches"].where("batch_id % 1000 = 2").select("batch_id")
    kept = cascade(
        tables, {"accounts": "account_id", "actions": "action_id", "batches": "batch_id"},
        [Reference("actions", "account_id", "accounts"), Reference("actions", "copied_from", "actions"),
         Reference("batches", "action_id", "actions"), Reference("logs", "action_id", "actions"),
         Reference("logs", "batch_id", "batches"), Reference("logs", "reviewer", "accounts", clear=True)],
        {"accounts": actions.where("account_id = 3").select("account_id").distinct(),
         "batches": batches})
    key = {"accounts": "account_id", "actions": "action_id", "batches": "batch_id", "logs": "log_id"}
    none = F.lit(None).cast("bigint")
    return reduce(lambda x, y: x.unionByName(y), [kept[n].select(
        F.lit(n).alias("name"), F.col(key[n]).alias("id"),
        (F.col("reviewer") if n == "logs" else none).alias("reviewer")) for n in tables])


# Every event asks for a status of its user's action.
_STATUS = "CASE {n} " + " ".join(
    f"WHEN {i} THEN '{s}'" for i, s in enumerate([
        "queued", "planning", "processing", "processing", "scheduled", "planning", "failed",
        "completed", "unknown"])) + " ELSE 'processing' END"
_ASKED = "event_id, user_id * 4 + event_id % 4 AS action_id, " + _STATUS.format(
    n="(event_id * 31 + CAST(floor(value) AS BIGINT)) % 12") + " AS status"
_HISTORY = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY event_id)
        AS i FROM (SELECT {_ASKED} FROM events)),
      t AS (SELECT action_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS status,
              NULL::VARCHAR AS before, 'queued' AS after, NULL::BOOLEAN AS allowed
            FROM (SELECT DISTINCT action_id FROM s)
            UNION ALL
            SELECT action_id, i, event_id, status, before, CASE WHEN ok THEN status ELSE before END, ok
            FROM (SELECT s.*, t.after AS before,
                    t.after NOT IN ('failed', 'completed') AND CASE
                      WHEN s.status IN ('planning', 'processing')
                        THEN t.after IN ('queued', 'scheduled', 'planning')
                      WHEN s.status = 'completed' THEN t.after IN ('planning', 'processing')
                      ELSE s.status = 'failed' END AS ok
                  FROM t JOIN s ON s.action_id = t.action_id AND s.i = t.i + 1))"""


@query("status_history", _HISTORY + """
    SELECT action_id, event_id, status, before, after, allowed FROM t WHERE i > 0""")
def status_history(spark, sf):
    asked = spark.sql(f"SELECT {_ASKED} FROM {{e}}", e=table(spark, sf, "events"))
    return fold_statuses(asked, "action_id", ["event_id"]).select(
        "action_id", "event_id", "status", "before", "after", "allowed")


@query("status_final", _HISTORY + """
    SELECT action_id, arg_max(after, i) AS status, count(*) AS steps,
           count(*) FILTER (NOT allowed) AS refused FROM t WHERE i > 0 GROUP BY action_id""")
def status_final(spark, sf):
    asked = spark.sql(f"SELECT {_ASKED} FROM {{e}}", e=table(spark, sf, "events"))
    return final_statuses(fold_statuses(asked, "action_id", ["event_id"]), "action_id", ["event_id"])


@query("entities_deep_page", f"""
    SELECT o_orderkey, o_orderdate, count(*) OVER () AS total, true AS has_more
    FROM {ORDERS_SQL} ORDER BY o_orderdate DESC, o_orderkey
    LIMIT 50 OFFSET (SELECT count(*) * 3 // 5 FROM orders)""")
def entities_deep_page(spark, sf):
    """A page that begins behind three fifths of all rows."""
    rows = orders(spark, sf).select("o_orderkey", "o_orderdate")
    pages = Pages(rows, newest_first(rows, "o_orderdate", "o_orderkey"))
    return pages.page(50, pages.total * 3 // 5)
