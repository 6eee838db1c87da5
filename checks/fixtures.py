"""Entities declared over the test tables, and tables derived from them.

Every derived table exists twice: as a DataFrame and as SQL text with the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.model import EntitySpec, FieldRule, register_entity

AS_OF = "2024-02-01 00:00:00"

ORDERS = register_entity(EntitySpec(
    name="orders", pk="o_orderkey", account="o_orderpriority",
    fields={
        "o_orderstatus": FieldRule(min_length=1, max_length=50),
        "o_totalprice": FieldRule("double", minimum=0),
        "o_custkey": FieldRule("bigint", minimum=0),
        "o_orderdate": FieldRule("timestamp", nullable=True),
    },
    dedup_fields=("o_custkey",)))

# Orders with the soft-delete marker itself as a filterable field.
ORDERS_RAW = EntitySpec(
    name="orders_raw", pk="o_orderkey", account="o_orderpriority", soft_delete=None,
    fields={**ORDERS.fields, "deleted_at": FieldRule("timestamp", nullable=True)})

CUSTOMER = register_entity(EntitySpec(
    name="customer", pk="c_custkey", account="c_nationkey", updated_at=None,
    fields={
        "c_name": FieldRule(min_length=1, max_length=255),
        "c_acctbal": FieldRule("double", minimum=-1000, maximum=10_000),
        "c_mktsegment": FieldRule(min_length=1, max_length=50),
    },
    dedup_fields=("c_mktsegment",)))

SUPPLIER = register_entity(EntitySpec(
    name="supplier", pk="s_suppkey", account="s_nationkey", soft_delete=None, updated_at=None,
    fields={
        "s_name": FieldRule(min_length=1, max_length=255),
        "s_acctbal": FieldRule("double", minimum=-1000, maximum=10_000),
    }))

PART = register_entity(EntitySpec(
    name="part", pk="p_partkey", account="p_brand", soft_delete=None, updated_at=None,
    fields={
        "p_name": FieldRule(min_length=1, max_length=255),
        "p_type": FieldRule(min_length=1, max_length=50),
        "p_size": FieldRule("int", minimum=1, maximum=50),
    },
    dedup_fields=("p_name",)))

DOCUMENTS = register_entity(EntitySpec(
    name="documents", pk="doc_id", account="source", soft_delete=None, updated_at=None,
    fields={"lang": FieldRule(min_length=1, max_length=8), "text": FieldRule()},
    dedup_fields=("text",)))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _deleted(pk: str) -> str:
    return f"CASE WHEN {pk} % 17 = 0 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' END"


def _deleted_sql(pk: str) -> str:
    return f"CASE WHEN {pk} % 17 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumns({
        "deleted_at": F.expr(_deleted("o_orderkey")), "updated_at": F.col("o_orderdate")})


ORDERS_SQL = (f"(SELECT *, {_deleted_sql('o_orderkey')} AS deleted_at, "
              "o_orderdate AS updated_at FROM orders)")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").withColumn("deleted_at", F.expr(_deleted("c_custkey")))


CUSTOMERS_SQL = f"(SELECT *, {_deleted_sql('c_custkey')} AS deleted_at FROM customer)"


def shrunken_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as they are after the oldest left the table since planning."""
    return orders(spark, sf).where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'")


SHRUNKEN_SQL = (f"(SELECT * FROM {ORDERS_SQL} "
                "WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00')")


# Duplicate keys with noise: missing, blank, upper case and surrounded by white space.
NOISY_KEY = ("CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '  ' "
             "WHEN p_partkey % 3 = 0 THEN '  ' || upper(p_name) || ' ' ELSE p_name END")


def noisy_part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumn("p_name", F.expr(NOISY_KEY))


NOISY_PART_SQL = f"(SELECT * EXCLUDE (p_name), {NOISY_KEY} AS p_name FROM part)"


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of the event users, with a limit and a name each."""
    return table(spark, sf, "events").select("user_id").distinct().selectExpr(
        "user_id AS account_id", "60 + (user_id % 25) * 40 AS rate_limit_per_minute",
        "concat('user ', user_id) AS name")


ACCOUNTS_SQL = ("(SELECT DISTINCT user_id AS account_id, 60 + (user_id % 25) * 40 "
                "AS rate_limit_per_minute, 'user ' || user_id AS name FROM events)")


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as submitted requests."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS id", "user_id AS account_id", "ts AS created_at",
        "event_type AS idempotency_key", "cast(floor(value * 10) AS bigint) AS batch_size",
        "CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 3 DAY "
        "WHEN event_id % 31 = 0 THEN ts - INTERVAL 1 MINUTE END AS scheduled_at")


SUBMISSIONS_SQL = """(SELECT event_id AS id, user_id AS account_id, ts AS created_at,
  event_type AS idempotency_key, CAST(floor(value * 10) AS BIGINT) AS batch_size,
  CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 3 DAY
       WHEN event_id % 31 = 0 THEN ts - INTERVAL 1 MINUTE END AS scheduled_at FROM events)"""


_AUDIT = """event_id AS log_id, user_id AS action_id, {div} AS batch_index,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END
    AS status,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'error' AND event_id % 2 = 0
       THEN 'entity_not_found' WHEN event_type = 'error' THEN 'batch_error'
       WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'no_change'
       WHEN event_type = 'signup' THEN 'duplicate_key' ELSE 'updated' END AS reason_code,
  event_id % 50 AS entity_id"""


def audit(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as audit rows: a user is an action, 100 consecutive events share a batch."""
    return spark.sql("SELECT " + _AUDIT.format(div="event_id div 100") + " FROM {e}",
                     e=table(spark, sf, "events"))


AUDIT_SQL = "(SELECT " + _AUDIT.format(div="event_id // 100") + " FROM events)"


def audit_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batch rows of the audit view: counters, and a status and times derived from the keys."""
    return spark.sql("""
        SELECT action_id, batch_index, count(*) AS entity_count,
               count_if(status = 'success') AS success_count,
               count_if(status = 'failed') AS failure_count,
               count_if(status = 'skipped') AS skipped_count,
               count(*) AS processed_count,
               'completed' AS status,
               TIMESTAMP_NTZ '2024-02-01 00:00:00' + make_dt_interval(0, 0, 0, batch_index)
                 AS finished_at
        FROM {a} GROUP BY action_id, batch_index""", a=audit(spark, sf))


AUDIT_BATCHES_SQL = f"""(
  SELECT action_id, batch_index, count(*) AS entity_count,
         count(*) FILTER (status = 'success') AS success_count,
         count(*) FILTER (status = 'failed') AS failure_count,
         count(*) FILTER (status = 'skipped') AS skipped_count,
         count(*) AS processed_count, 'completed' AS status,
         TIMESTAMP '2024-02-01 00:00:00' + to_seconds(batch_index) AS finished_at
  FROM {AUDIT_SQL} GROUP BY action_id, batch_index)"""


def open_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batch rows of which some have not finished."""
    return audit_batches(spark, sf).selectExpr(
        "action_id", "batch_index", "entity_count",
        "CASE WHEN (action_id + batch_index) % 4 = 0 THEN 'pending' ELSE status END AS status",
        "CASE WHEN (action_id + batch_index) % 4 <> 0 THEN finished_at END AS finished_at",
        *[f"CASE WHEN (action_id + batch_index) % 4 = 0 THEN 0L ELSE {c} END AS {c}"
          for c in ("success_count", "failure_count", "skipped_count", "processed_count")])


OPEN_BATCHES_SQL = f"""(
  SELECT action_id, batch_index, entity_count,
    CASE WHEN (action_id + batch_index) % 4 = 0 THEN 'pending' ELSE status END AS status,
    CASE WHEN (action_id + batch_index) % 4 <> 0 THEN finished_at END AS finished_at,
    """ + ",\n    ".join(
    f"CASE WHEN (action_id + batch_index) % 4 = 0 THEN 0 ELSE {c} END AS {c}"
    for c in ("success_count", "failure_count", "skipped_count", "processed_count")) + f"""
  FROM {AUDIT_BATCHES_SQL})"""


def id_list(spark: SparkSession, sf: str) -> DataFrame:
    """A request's order keys, taken from the events: repeated, unordered, some unknown."""
    return table(spark, sf, "events").selectExpr(
        "-event_id AS pos",
        "CASE WHEN event_id % 9 = 0 THEN -1 - event_id ELSE (event_id div 2) * 3 END "
        "AS o_orderkey")


ID_LIST_SQL = """(SELECT -event_id AS pos,
  CASE WHEN event_id % 9 = 0 THEN -1 - event_id ELSE (event_id // 2) * 3 END AS o_orderkey
  FROM events)"""
