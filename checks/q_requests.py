"""Submitted requests: validation, replays, schedules, acceptance; generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    ACCOUNTS_SQL,
    AS_OF,
    SUBMISSIONS_SQL,
    CUSTOMER,
    accounts,
    submissions,
    table,
)
from checks.registry import query
from swathe.model import COMPANY, CONTACT
from swathe.operators import submissions as sub
from swathe.operators.actions import entity_action_matrix
from swathe.sources import seeding

# Requests with every kind of mistake, derived from the events.
_TYPED = [
    "event_id AS id",
    "ts AS created_at",
    "CASE WHEN event_id % 17 = 0 THEN repeat('k', 256) WHEN event_id % 3 = 0 THEN event_type "
    "WHEN event_id % 3 = 1 THEN '' END AS idempotency_key",
    "CASE event_id % 6 WHEN 0 THEN 'contact' WHEN 1 THEN ' Company ' WHEN 2 THEN 'customer' "
    "WHEN 3 THEN 'supplier' WHEN 4 THEN 'unicorn' ELSE 'orders' END AS entity_type",
    "CASE event_id % 5 WHEN 0 THEN 'update' WHEN 1 THEN 'DELETE ' WHEN 2 THEN 'archive' "
    "WHEN 3 THEN 'teleport' ELSE 'tag' END AS action_type",
    """CASE event_id % 9 WHEN 0 THEN '{"filter":{},"updates":{"status":"x"}}'
    WHEN 1 THEN '{"entity_ids":[1,2],"updates":{"status":"x"}}'
    WHEN 2 THEN '{"filter":{},"entity_ids":[1]}' WHEN 3 THEN '{}'
    WHEN 4 THEN '{"entity_ids":[],"hard":true}'
    WHEN 5 THEN '{"filter":{},"deduplicate_by":"email"}'
    WHEN 6 THEN '{"filter":{},"hardly":true}'
    WHEN 7 THEN '{"filter":{},"suffix":" [VIP]"}'
    ELSE '{"filter":{},"updates":{}}' END AS payload""",
    "CASE WHEN event_id % 13 = 0 THEN -1 - user_id ELSE user_id END AS account_id",
    "CAST(floor(value * 20) AS BIGINT) - 200 AS batch_size",
    "CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 3 DAY "
    "WHEN event_id % 31 = 0 THEN ts - INTERVAL 1 MINUTE END AS scheduled_at",
]


def requests(spark, sf):
    return table(spark, sf, "events").selectExpr(*_TYPED)


REQUESTS_SQL = f"(SELECT {', '.join(_TYPED)} FROM events)"

_KEYS_SQL = """len(list_filter(json_keys(payload), lambda k: NOT list_contains({allowed}, k))) > 0"""
_COMMON = "'filter', 'entity_ids', 'deduplicate_by'"
_CHECKED_SQL = f"""(
  SELECT * REPLACE (CASE WHEN errors = '' AND action = 'update'
      AND entity IN ('customer', 'supplier', 'orders') THEN 'status:not_updatable'
      ELSE errors END AS errors) FROM (
  SELECT r.*, concat_ws(';',
    CASE WHEN a.account_id IS NULL THEN 'account_id:unknown_account' END,
    CASE WHEN action NOT IN ('update', 'delete', 'archive', 'tag')
      THEN 'action_type:unknown_action' END,
    CASE WHEN batch_size NOT BETWEEN 1 AND 10000 THEN 'batch_size:out_of_range' END,
    CASE WHEN known AND json_extract_string(payload, '$.deduplicate_by') = 'email'
      AND entity <> 'contact' THEN 'deduplicate_by:not_a_dedup_field' END,
    CASE WHEN json_array_length(payload, '$.entity_ids') = 0
      AND list_contains(json_keys(payload), 'entity_ids') THEN 'entity_ids:empty' END,
    CASE WHEN NOT known THEN 'entity_type:unknown_entity' END,
    CASE WHEN NOT has_filter AND NOT has_ids THEN 'filter:no_target_set'
         WHEN has_filter AND has_ids THEN 'filter:two_target_sets' END,
    CASE WHEN action = 'delete' AND entity = 'supplier'
      AND NOT list_contains(json_keys(payload), 'hard') THEN 'hard:no_soft_delete_column' END,
    CASE WHEN length(idempotency_key) > 255 THEN 'idempotency_key:too_long' END,
    CASE WHEN action = 'update' AND {_KEYS_SQL.format(allowed=f"['updates', {_COMMON}]")}
        THEN 'payload:unknown_key'
      WHEN action = 'delete' AND {_KEYS_SQL.format(allowed=f"['hard', {_COMMON}]")}
        THEN 'payload:unknown_key'
      WHEN action = 'archive' AND {_KEYS_SQL.format(allowed=f"['status', 'column', {_COMMON}]")}
        THEN 'payload:unknown_key'
      WHEN action = 'tag' AND {_KEYS_SQL.format(allowed=f"['suffix', 'column', {_COMMON}]")}
        THEN 'payload:unknown_key'
      WHEN action = 'update' AND NOT list_contains(json_keys(payload), 'updates')
        THEN 'payload:missing_key'
      WHEN action = 'tag' AND NOT list_contains(json_keys(payload), 'suffix')
        THEN 'payload:missing_key' END,
    CASE WHEN scheduled_at <= created_at THEN 'scheduled_at:not_in_future' END,
    CASE WHEN len(json_keys(payload, '$.updates')) = 0
      AND list_contains(json_keys(payload), 'updates') THEN 'updates:empty' END) AS errors
  FROM (SELECT *, lower(trim(entity_type)) AS entity, lower(trim(action_type)) AS action,
          lower(trim(entity_type)) <> 'unicorn' AS known,
          list_contains(json_keys(payload), 'filter') AS has_filter,
          list_contains(json_keys(payload), 'entity_ids') AS has_ids
        FROM {REQUESTS_SQL}) r
  LEFT JOIN {ACCOUNTS_SQL} a USING (account_id)))"""


@query("validate_submissions", f"SELECT id, errors FROM {_CHECKED_SQL}")
def validate_submissions(spark, sf):
    checked = sub.validate_submissions(requests(spark, sf), accounts(spark, sf))
    return checked.select("id", sub.error_text().alias("errors"))


_VALUES = """CASE event_id % 12
    WHEN 0 THEN '{"filter":{},"updates":{"age":500}}'
    WHEN 1 THEN '{"filter":{},"updates":{"age":"x","name":"  "}}'
    WHEN 2 THEN '{"filter":{"nope":1},"updates":{"age":3}}'
    WHEN 3 THEN '{"filter":{"age":{"like":1}},"updates":{"nickname":"x"}}'
    WHEN 4 THEN '{"filter":7,"updates":"zzz"}'
    WHEN 5 THEN '{"entity_ids":7,"updates":{"age":3}}'
    WHEN 6 THEN '{"filter":{"age":{"gte":3,"lt":9},"status":"a"},"updates":{"age":null}}'
    WHEN 7 THEN '{"filter":{},"updates":{"email":"no mail"}}'
    WHEN 8 THEN '{"filter":{},"updates":{"name":null}}'
    WHEN 9 THEN '{"filter":{"updated_at":{"is_null":true}},"updates":{"email":"a@b.cd"}}'
    WHEN 10 THEN '{"entity_ids":[1],"updates":{"age":1.5}}'
    ELSE '{"filter":{},"updates":[1]}' END"""

# Values of filters on contacts (age is a whole number, name and status are text).
_FILTERS = [
    ('{"age":"x"}', "bad_value"), ('{"age":{"gte":3.5,"lt":null}}', ""), ('{"age":{"in":[]}}', "bad_value"),
    ('{"age":{"in":[1,null,"7"]}}', ""), ('{"age":{"in":[1,"seven"]}}', "bad_value"),
    ('{"age":{"in":3}}', "bad_value"), ('{"name":7}', "bad_value"), ('{"name":{"contains":"x"}}', ""),
    ('{"age":{"contains":"1"}}', "bad_value"), ('{"age":true}', "bad_value"), ('{"name":null}', ""),
    ('{"updated_at":{"gt":"2024-01-01T00:00:00Z"}}', ""), ('{"updated_at":{"gt":"soon"}}', "bad_value"),
    ('{"age":{"is_null":"yes"}}', "bad_value"), ('{"age":{"eq":99999999999}}', "bad_value"),
    ('{"status":{"not_in":["a","b"],"ne":null}}', ""), ('{"status":["a"]}', "bad_value"),
    ('{"age":{"is_null":false},"status":{"eq":"a"}}', "")]
_FILTER_CASES = "CASE event_id % 18 " + " ".join(
    f"WHEN {i} THEN '{f}'" for i, (f, _) in enumerate(_FILTERS)) + " END"


@query("validate_filter_values", "SELECT event_id AS id, CASE event_id % 18 " + " ".join(
    f"WHEN {i} THEN '{'filter:' + e if e else ''}'" for i, (_, e) in enumerate(_FILTERS))
    + " END AS errors FROM events")
def validate_filter_values(spark, sf):
    asked = table(spark, sf, "events").selectExpr(
        "event_id AS id", "ts AS created_at", "CAST(NULL AS string) AS idempotency_key",
        "'contact' AS entity_type", "'delete' AS action_type",
        f"concat('{{\"filter\":', {_FILTER_CASES}, '}}') AS payload",
        "user_id AS account_id", "CAST(10 AS bigint) AS batch_size",
        "CAST(NULL AS timestamp_ntz) AS scheduled_at")
    checked = sub.validate_submissions(asked, accounts(spark, sf))
    return checked.select("id", sub.error_text().alias("errors"))


@query("validate_values", """
    SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN 'age:above_maximum'
      WHEN 1 THEN 'age:not_a_number;name:too_short' WHEN 2 THEN 'filter:not_filterable'
      WHEN 3 THEN 'filter:unknown_operator;nickname:not_updatable'
      WHEN 4 THEN 'filter:not_an_object;updates:not_an_object' WHEN 5 THEN 'entity_ids:not_a_list'
      WHEN 7 THEN 'email:pattern_mismatch' WHEN 8 THEN 'name:null_not_allowed'
      WHEN 10 THEN 'age:not_a_number' WHEN 11 THEN 'updates:not_an_object' ELSE '' END AS errors
    FROM events""")
def validate_values(spark, sf):
    asked = table(spark, sf, "events").selectExpr(
        "event_id AS id", "ts AS created_at", "CAST(NULL AS string) AS idempotency_key",
        "'contact' AS entity_type", "'update' AS action_type", f"{_VALUES} AS payload",
        "user_id AS account_id", "CAST(10 AS bigint) AS batch_size",
        "CAST(NULL AS timestamp_ntz) AS scheduled_at")
    checked = sub.validate_submissions(asked, accounts(spark, sf))
    return checked.select("id", sub.error_text().alias("errors"))


@query("accept_submissions", f"""
    WITH c AS (SELECT * FROM {_CHECKED_SQL}),
    v AS (SELECT *, CASE WHEN idempotency_key <> '' THEN first_value(id) OVER (
            PARTITION BY account_id, idempotency_key ORDER BY created_at, id) ELSE id END AS owner
          FROM c WHERE errors = ''),
    b AS (SELECT c.id, CASE WHEN c.errors NOT LIKE '%account_id:%'
            AND c.errors NOT LIKE '%batch_size:%' AND c.errors NOT LIKE '%idempotency_key:%'
            AND (c.created_at, c.id) > (v.created_at, v.id) THEN v.id END AS owner
          FROM c LEFT JOIN v ON v.id = v.owner AND v.account_id = c.account_id
            AND v.idempotency_key = c.idempotency_key AND c.idempotency_key <> ''
          WHERE c.errors <> '')
    SELECT id, CASE WHEN owner IS NULL THEN 'rejected' ELSE 'replayed' END AS decision,
      owner AS replay_of, CAST(NULL AS VARCHAR) AS status,
      CAST(NULL AS BIGINT) AS effective_batch_size FROM b
    UNION ALL SELECT id, 'replayed', owner, NULL, NULL FROM v WHERE id <> owner
    UNION ALL SELECT id, 'accepted', NULL,
      CASE WHEN scheduled_at IS NULL THEN 'queued' ELSE 'scheduled' END,
      least(batch_size, rate_limit_per_minute) FROM v JOIN {ACCOUNTS_SQL} USING (account_id)
    WHERE id = owner""")
def accept_submissions(spark, sf):
    return sub.accept_submissions(requests(spark, sf), accounts(spark, sf)).select(
        "id", "decision", "replay_of", "status", "effective_batch_size")


@query("entity_action_matrix", f"""
    SELECT entity, action, entity <> 'unicorn' AND action <> 'teleport' AS supported,
      count(*) AS requests
    FROM (SELECT lower(trim(entity_type)) AS entity, lower(trim(action_type)) AS action
          FROM {REQUESTS_SQL}) GROUP BY ALL""")
def matrix(spark, sf):
    from swathe.functions.text import type_name
    asked = requests(spark, sf).groupBy(
        type_name("entity_type").alias("entity"), type_name("action_type").alias("action")
    ).agg(F.count("*").alias("requests"))
    pairs = entity_action_matrix(spark)
    return asked.join(pairs, (F.col("entity") == F.col("entity_type"))
                      & (F.col("action") == F.col("action_type")), "left").select(
        "entity", "action", F.col("action_type").isNotNull().alias("supported"), "requests")


_CHANGES = """SELECT c_custkey,
  CASE WHEN c_custkey % 5 = 0 THEN '   ' ELSE c_name END AS v_name,
  CASE WHEN c_custkey % 7 = 0 THEN 'abc' WHEN c_custkey % 11 = 0 THEN '20000'
       ELSE CAST(c_acctbal AS {text}) END AS v_acctbal,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN repeat('x', 51)
       ELSE c_mktsegment END AS v_segment FROM {c}"""


@query("validate_updates", f"""
    SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN 'updates:empty' ELSE concat_ws(';',
      CASE WHEN try_cast(v_acctbal AS DOUBLE) IS NULL THEN 'c_acctbal:not_a_number'
        WHEN CAST(v_acctbal AS DOUBLE) > 10000 THEN 'c_acctbal:above_maximum' END,
      CASE WHEN v_segment IS NULL THEN 'c_mktsegment:null_not_allowed'
        WHEN length(trim(v_segment)) > 50 THEN 'c_mktsegment:too_long' END,
      CASE WHEN length(trim(v_name)) < 1 THEN 'c_name:too_short' END,
      CASE WHEN c_custkey % 13 = 0 THEN 'nickname:not_updatable' END) END AS errors
    FROM ({_CHANGES.format(text='VARCHAR', c='customer')})""")
def validate_updates(spark, sf):
    rows = spark.sql(_CHANGES.format(text="STRING", c="{c}"), c=table(spark, sf, "customer"))
    rows = rows.selectExpr("c_custkey", """map_filter(
        map('c_name', v_name, 'c_acctbal', v_acctbal, 'c_mktsegment', v_segment,
            'nickname', 'x'),
        (k, v) -> c_custkey % 19 <> 0 AND (k <> 'nickname' OR c_custkey % 13 = 0)) AS updates""")
    return sub.validate_updates(rows, CUSTOMER).select(
        "c_custkey", sub.error_text().alias("errors"))


_CONTACTS = """SELECT c_custkey,
  CASE WHEN c_custkey % 4 = 0 THEN 'no-at-sign' WHEN c_custkey % 9 = 0 THEN 'a b@x.y'
       ELSE replace(lower(c_name), '#', '.') || '@example.com' END AS v_email,
  CASE WHEN c_custkey % 6 = 0 THEN '42.5' WHEN c_custkey % 10 = 0 THEN NULL
       ELSE CAST(CAST(floor(c_acctbal / 20) AS BIGINT) AS {text}) END AS v_age FROM {c}"""


@query("validate_contacts", f"""
    SELECT c_custkey, concat_ws(';',
      CASE WHEN c_custkey % 6 = 0 THEN 'age:not_a_number'
        WHEN CAST(v_age AS BIGINT) < 0 THEN 'age:below_minimum'
        WHEN CAST(v_age AS BIGINT) > 150 THEN 'age:above_maximum' END,
      CASE WHEN NOT regexp_matches(v_email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
        THEN 'email:pattern_mismatch' END) AS errors,
      CASE WHEN c_custkey % 6 <> 0 THEN CAST(v_age AS INTEGER) END AS new_age
    FROM ({_CONTACTS.format(text='VARCHAR', c='customer')})""")
def validate_contacts(spark, sf):
    rows = spark.sql(_CONTACTS.format(text="STRING", c="{c}"), c=table(spark, sf, "customer"))
    rows = rows.selectExpr("c_custkey", "map('email', v_email, 'age', v_age) AS updates")
    checked = sub.coerced_updates(sub.validate_updates(rows, CONTACT), CONTACT)
    return checked.select("c_custkey", sub.error_text().alias("errors"), "new_age")


@query("validate_accounts", """
    SELECT account_id, concat_ws(';', CASE WHEN name = '' THEN 'name:too_short'
        WHEN length(name) > 255 THEN 'name:too_long' END,
      CASE WHEN l < 1 THEN 'rate_limit_per_minute:below_minimum'
        WHEN l > 10000000 THEN 'rate_limit_per_minute:above_maximum' END) AS errors
    FROM (SELECT DISTINCT user_id AS account_id, (user_id - 20) * 100000 AS l,
            CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 11 = 0 THEN repeat('n', 256)
                 ELSE 'user' END AS name FROM events)""")
def validate_accounts(spark, sf):
    rows = table(spark, sf, "events").select("user_id").distinct().selectExpr(
        "user_id AS account_id", "(user_id - 20) * 100000 AS rate_limit_per_minute",
        "CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 11 = 0 THEN repeat('n', 256) "
        "ELSE 'user' END AS name")
    return sub.validate_accounts(rows).select("account_id", sub.error_text().alias("errors"))


@query("validate_seed_requests", """
    SELECT event_id, concat_ws(';',
      CASE WHEN event_id * 150 - 300 NOT BETWEEN 1 AND 1000000 THEN 'count:out_of_range' END,
      CASE WHEN value / 200 > 0.9 THEN 'duplicate_ratio:out_of_range' END) AS errors FROM events""")
def validate_seed_requests(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "event_id * 150 - 300 AS count", "value / 200 AS duplicate_ratio")
    return sub.validate_seed_requests(rows).select("event_id", sub.error_text().alias("errors"))


@query("idempotent_submissions", f"""
    SELECT id, account_id, idempotency_key FROM (SELECT *, row_number() OVER (
      PARTITION BY account_id, idempotency_key ORDER BY created_at, id) AS n
      FROM {SUBMISSIONS_SQL}) WHERE n = 1""")
def idempotent(spark, sf):
    return sub.first_submissions(submissions(spark, sf)).select(
        "id", "account_id", "idempotency_key")


@query("submission_replays", f"""
    WITH stored AS (SELECT DISTINCT account_id, 'view' AS idempotency_key, -1 - account_id AS id
                    FROM {SUBMISSIONS_SQL} WHERE batch_size > 4000),
    f AS (SELECT *, first_value(id) OVER (PARTITION BY account_id, idempotency_key
            ORDER BY created_at, id) AS first FROM {SUBMISSIONS_SQL})
    SELECT f.id, nullif(coalesce(stored.id, first), f.id) AS replay_of
    FROM f LEFT JOIN stored USING (account_id, idempotency_key)""")
def replays(spark, sf):
    rows = submissions(spark, sf)
    stored = rows.where("batch_size > 4000").select("account_id").distinct().selectExpr(
        "account_id", "'view' AS idempotency_key", "-1 - account_id AS id")
    return sub.mark_replays(rows, stored).select("id", "replay_of")


@query("initial_status", f"""
    SELECT id, CASE WHEN scheduled_at IS NULL THEN 'queued'
        WHEN scheduled_at > created_at THEN 'scheduled' END AS status,
      CASE WHEN scheduled_at <= created_at THEN 'scheduled_at_not_in_future' END AS error
    FROM {SUBMISSIONS_SQL}""")
def initial_status(spark, sf):
    return sub.initial_status(submissions(spark, sf)).select("id", "status", "error")


@query("due_actions", f"""
    SELECT id FROM {SUBMISSIONS_SQL}
    WHERE scheduled_at > created_at AND scheduled_at <= TIMESTAMP '2024-01-20 00:00:00'""")
def due_actions(spark, sf):
    actions = sub.initial_status(submissions(spark, sf))
    return sub.due(actions, F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))).select("id")


# --- generated rows: one per order, so the work follows the table ---------------------------

def _draw(index, salt):
    return f"CAST('0x' || substr(md5('{salt}:' || {index}), 1, 7) AS BIGINT)"


def _pick(values, index, salt):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{listed}], {_draw(index, salt)} % {len(values)} + 1)"


def _people_sql(index, owner):
    return f"""md5('3:contact:' || {index}) AS id, 'acct' AS account_id,
      {_pick(seeding.FIRST_NAMES, index, '3:name')} || ' '
        || {_pick(seeding.LAST_NAMES, index, '3:name:last')} AS name,
      lower({_pick(seeding.FIRST_NAMES, owner, '3:email')}) || '.' || {owner} || '@'
        || {_pick(seeding.MAIL_DOMAINS, owner, '3:email:domain')} AS email,
      CAST({_draw(index, '3:age')} % 58 + 18 AS INTEGER) AS age,
      {_pick(seeding.STATUSES, index, '3:status')} AS status"""


@query("seed_rows", f"""
    WITH r AS (SELECT o_orderkey AS i, o_orderkey // 5000 AS c,
                 o_orderkey % 5000 <> 0 AND {_draw('o_orderkey', '3:repeat')} < {int(0.3 * 2**28)}
                   AS again FROM orders),
    m AS (SELECT *, count(*) FILTER (NOT again) OVER (PARTITION BY c ORDER BY i) AS minted FROM r),
    o AS (SELECT m.i, coalesce(s.i, m.i) AS owner FROM m LEFT JOIN m s ON s.c = m.c AND NOT s.again
            AND m.again AND s.minted = {_draw('m.i', '3:source')} % m.minted + 1)
    SELECT {_people_sql('i', 'owner')} FROM o""")
def seed_rows(spark, sf):
    spine = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_no"))
    rows = seeding.seed_rows(spine, CONTACT, "acct", AS_OF, duplicate_ratio=0.3, seed=3)
    return rows.select("id", "account_id", "name", "email", "age", "status")


@query("seed_companies", f"""
    SELECT md5('5:company:' || c_custkey) AS id,
      'company-' || c_custkey || '.' || {_pick(seeding.COMPANY_SUFFIXES, 'c_custkey', '5:domain')}
        AS domain,
      {_pick(seeding.INDUSTRIES, 'c_custkey', '5:industry')} AS industry,
      CAST({_draw('c_custkey', '5:employee_count')} % 58 + 18 AS INTEGER) AS employee_count
    FROM customer""")
def seed_companies(spark, sf):
    spine = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_no"))
    rows = seeding.seed_rows(spine, COMPANY, "acct", AS_OF, seed=5)
    return rows.select("id", "domain", "industry", "employee_count")
