"""A store of versions, an action that runs in several goes, and writers that meet."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import ORDERS, ORDERS_SQL, orders, table
from checks.registry import query
from swathe.model import ActionSpec
from swathe.plans import resume
from swathe.sources.staging import staging_path
from swathe.sources.store import Store, insert_if_absent

# Twenty rows a batch, sixty a minute: every go, a minute apart, runs three batches.
SIZE, PER_GO, GOES = 20, 3, 3
SPEC = ActionSpec("update", "2-HIGH", {"o_totalprice": {"gte": 1000}}, None, "o_custkey", SIZE,
                  {"updates": {"o_orderstatus": "X"}}, "goes", rate_limit_per_minute=SIZE * PER_GO)
TIMES = [f"2024-03-01 00:0{k}:00" for k in range(GOES + 1)]


@cache
def _goes(spark: SparkSession, sf: str) -> Store:
    """Orders after three goes of an action and its cancellation. Versions: 1 the table, 2 the plan,
    3 to 5 the goes, 6 the cancellation (where batches were left)."""
    store = Store(spark, staging_path(spark, "store"))
    store.create(orders(spark, sf).repartitionByRange(4, "o_orderkey"))
    resume.submit(store, ORDERS, SPEC, TIMES[0])
    resume.submit(store, ORDERS, SPEC, TIMES[0])  # twice: the second changes nothing
    for at in TIMES[:GOES]:
        resume.advance(store, ORDERS, SPEC, at)
        resume.advance(store, ORDERS, SPEC, at)  # delivered again: the bucket is empty
    resume.cancel(store, SPEC.action_id, TIMES[GOES])
    return store


def _rows(goes: int) -> str:
    """Target rows with their batch and, as far as they ran in so many goes, their class."""
    return f"""t AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // {SIZE} AS batch_index
        FROM {ORDERS_SQL} WHERE o_orderpriority = '2-HIGH' AND deleted_at IS NULL
          AND o_totalprice >= 1000),
      r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1
                 THEN 'duplicate_key' WHEN o_orderstatus = 'X' THEN 'no_change' ELSE 'updated' END
                 AS reason_code, batch_index // {PER_GO} AS go
            FROM t WHERE batch_index < {PER_GO * goes})"""


_OUTCOMES = f"""WITH {_rows(GOES)} SELECT 'goes' AS action_id, batch_index, o_orderkey AS entity_id,
    CASE reason_code WHEN 'updated' THEN 'success' ELSE 'skipped' END AS status, reason_code FROM r"""


@query("resume_outcomes", _OUTCOMES)
def resume_outcomes(spark, sf):
    """Audit rows of an action that ran in three goes and was then cancelled."""
    return _goes(spark, sf).rows("outcomes", action="goes").select(
        "action_id", "batch_index", "entity_id", "status", "reason_code")


_BATCHES = f"""b AS (SELECT batch_index, min(o_orderkey) AS cursor_start, max(o_orderkey) AS cursor_end,
        count(*) AS entity_count, batch_index < {PER_GO * GOES} AS ran FROM t GROUP BY 1),
    c AS (SELECT batch_index, count(*) FILTER (reason_code = 'updated') AS success_count,
            count(*) FILTER (reason_code <> 'updated') AS skipped_count FROM r GROUP BY 1)"""


@query("resume_batches", f"""WITH {_rows(GOES)}, {_BATCHES}
    SELECT batch_index, cursor_start, cursor_end, entity_count,
      CASE WHEN ran THEN 'completed' ELSE 'cancelled' END AS status,
      coalesce(success_count, 0) AS success_count, coalesce(skipped_count, 0) AS skipped_count,
      epoch_ms(TIMESTAMP '2024-03-01 00:00:00' + to_minutes(CASE WHEN ran
        THEN batch_index // {PER_GO} ELSE {GOES} END)) AS finished_ms
    FROM b LEFT JOIN c USING (batch_index)""")
def resume_batches(spark, sf):
    return resume.batches(_goes(spark, sf), "goes").select(
        "batch_index", "cursor_start", "cursor_end", "entity_count", "status", "success_count",
        "skipped_count", F.unix_millis("finished_at").alias("finished_ms"))


@query("resume_pending", f"""WITH {_rows(1)}, {_BATCHES}
    SELECT batch_index, entity_count, CASE WHEN batch_index < {PER_GO} THEN 'completed'
      ELSE 'pending' END AS status FROM b""")
def resume_pending(spark, sf):
    """Batches as they stood after the first go."""
    store = _goes(spark, sf)
    return resume.batches(store, "goes", 3).select("batch_index", "entity_count", "status")


@query("resume_stats", f"""WITH {_rows(GOES)}, {_BATCHES}
    SELECT CASE WHEN bool_and(ran) THEN 'completed' ELSE 'cancelled' END AS status,
      CAST(sum(entity_count) AS BIGINT) AS total_entities, CAST(coalesce(sum(success_count), 0) AS BIGINT)
      AS success_count, CAST(coalesce(sum(skipped_count), 0) AS BIGINT) AS skipped_count,
      count(*) AS total_batches, count(*) FILTER (ran) AS completed_batches
    FROM b LEFT JOIN c USING (batch_index)""")
def resume_stats(spark, sf):
    return resume.statistics(_goes(spark, sf), ORDERS, SPEC).select(
        "status", "total_entities", "success_count", "skipped_count", "total_batches",
        "completed_batches")


def _table(goes: int) -> str:
    at = "TIMESTAMP '2024-03-01 00:00:00' + to_minutes(go)"
    return f"""WITH {_rows(goes)}
        SELECT o.o_orderkey, CASE WHEN reason_code = 'updated' THEN 'X' ELSE o.o_orderstatus END
          AS o_orderstatus, o.o_totalprice, o.deleted_at,
          CASE WHEN reason_code = 'updated' THEN {at} ELSE o.updated_at END AS updated_at
        FROM {ORDERS_SQL} o LEFT JOIN r ON r.o_orderkey = o.o_orderkey"""


_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "deleted_at", "updated_at"]


@query("resume_table", _table(GOES))
def resume_table(spark, sf):
    return _goes(spark, sf).table().select(*_COLUMNS)


@query("store_two_versions_back", _table(1))
def store_two_versions_back(spark, sf):
    """The table as the first go left it, read after two more."""
    return _goes(spark, sf).table(3).select(*_COLUMNS)


def _claims(spark: SparkSession, sf: str, part: int) -> DataFrame:
    return table(spark, sf, "events").where(f"event_id % 3 <> {part}").selectExpr(
        "user_id", "event_type", "event_id")


@query("store_claims", """
    SELECT user_id, event_type, 1::BIGINT AS winners, true AS as_returned FROM events
    GROUP BY user_id, event_type""")
def store_claims(spark, sf):
    """Two writers insert overlapping keys at once: every key is won by one of them, and each is
    told which ones it won."""
    store = Store(spark, staging_path(spark, "claims"))
    store.create(spark.range(0))
    keys = ["user_id", "event_type"]
    with ThreadPoolExecutor(2) as pool:
        won = list(pool.map(lambda part: insert_if_absent(
            store, "claims", _claims(spark, sf, part), keys), range(2)))
    stored = store.rows("claims").withColumn("_stored", F.lit(True))
    told = won[0].unionByName(won[1]).withColumn("_told", F.lit(True))
    both = stored.join(told, [*keys, "event_id"], "full")
    return both.groupBy(*keys).agg(
        F.count("*").alias("winners"),
        F.bool_and(F.coalesce(F.col("_stored") & F.col("_told"), F.lit(False))).alias("as_returned"))
