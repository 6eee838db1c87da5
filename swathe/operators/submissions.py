"""Tables of submitted requests: validation, replays, scheduling, acceptance."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.functions.conditions import kind_of, member, members
from swathe.functions.measures import effective_batch_size
from swathe.functions.predicates import OPERATORS
from swathe.functions.rules import coerced, field_error, issue, issues, when_true
from swathe.functions.text import type_name
from swathe.model import (
    COMMON_FILTER_FIELDS,
    DEFAULT_SUBMISSIONS_PER_MINUTE,
    MAX_BATCH_SIZE,
    MAX_DUPLICATE_RATIO,
    MAX_IDEMPOTENCY_KEY_LENGTH,
    MAX_RATE_LIMIT_PER_MINUTE,
    MAX_SEED_ROWS,
    EntitySpec,
    all_entities,
)
from swathe.operators.actions import all_actions
from swathe.operators.ordered import mark_first
from swathe.operators.ratelimit import submission_limit
from swathe.sources.staging import stage


def validate_updates(df: DataFrame, entity: EntitySpec, updates: str = "updates") -> DataFrame:
    """Check a column of update payloads (``map<string,string>``) against the declaration; adds
    ``errors``, an array of ``(field, error)``."""
    payload = F.col(updates)
    names = F.map_keys(payload)
    unknown = F.transform(
        F.array_sort(F.array_except(names, F.array(*[F.lit(n) for n in entity.fields]))),
        lambda n: F.struct(n.alias("field"), F.lit("not_updatable").alias("error")))
    empty = issue("updates", when_true(payload.isNull() | (F.size(payload) == 0), "empty"))
    checks = [issue(name, F.when(F.map_contains_key(payload, name),
                                 field_error(F.element_at(payload, name), rule)))
              for name, rule in entity.fields.items()]
    found = F.concat(issues(empty, *checks),
                     F.coalesce(unknown, F.expr("array()").cast(
                         "array<struct<field:string,error:string>>")))
    return df.withColumn("errors", found)


def coerced_updates(df: DataFrame, entity: EntitySpec, updates: str = "updates") -> DataFrame:
    """Payload values in declared types, one column ``new_<field>`` per declared field; null for
    fields that were not sent."""
    return df.withColumns({
        f"new_{n}": coerced(F.element_at(F.col(updates), n), rule)
        for n, rule in entity.fields.items()})


def _lookup(values: Mapping[str, Any], key: Column, dtype: str) -> Column:
    """Declared metadata by name (a handful of registered entities or actions)."""
    pairs = [c for k, v in values.items()
             for c in (F.lit(k), F.lit(v) if not isinstance(v, list)
                       else F.array(*[F.lit(x) for x in v]).cast("array<string>"))]
    mapping = F.create_map(*pairs) if pairs else F.lit(None)
    return F.element_at(mapping.cast(f"map<string,{dtype}>"), key)


_ERRORS = "array<struct<field:string,error:string>>"


def _update_errors(entities: Mapping[str, EntitySpec], entity: Column, updates: Column) -> Column:
    """Errors of an update's fields and values, by the declaration of the request's entity."""
    names = F.map_keys(updates)
    out = F.lit(None).cast(_ERRORS)
    for name, spec in entities.items():
        unknown = F.transform(
            F.array_sort(F.array_except(names, F.array(*map(F.lit, spec.fields)))),
            lambda n: F.struct(n.alias("field"), F.lit("not_updatable").alias("error")))
        values = issues(*(issue(field, F.when(F.map_contains_key(updates, field),
                                              field_error(F.element_at(updates, field), rule)))
                          for field, rule in spec.fields.items()))
        out = F.when(entity == name, F.concat(unknown.cast(_ERRORS), values.cast(_ERRORS))
                     ).otherwise(out)
    return out


# Types of the common filter fields where an entity does not declare them itself.
_COMMON_TYPES = {n: "string" if n == "status" else "timestamp" for n in COMMON_FILTER_FIELDS}


def _filter_errors(entities: Mapping[str, EntitySpec], entity: Column, filters: Column) -> Column:
    """Errors of a filter's field names, operators and values. ``filters`` has the members as
    VARIANT by name; a value has to fit the declared type of its field."""
    types = F.element_at(F.create_map(*[c for n, e in entities.items() for c in (
        F.lit(n), F.create_map(*[F.lit(x) for pair in {
            **_COMMON_TYPES, **{f: r.type for f, r in e.fields.items() if r.filterable}}.items()
            for x in pair]))]), entity)
    unknown = F.exists(F.map_keys(filters), lambda n: ~F.map_contains_key(types, n))
    entries = F.transform(F.map_entries(filters), lambda e: F.struct(
        F.element_at(types, e["key"]).alias("type"), kind_of(e["value"]).alias("kind"),
        e["value"].alias("value"),
        F.coalesce(F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")),
                   F.array().cast("array<struct<key:string,value:variant>>")).alias("operators")))
    operators = F.exists(entries, lambda e: F.exists(
        e["operators"], lambda o: ~o["key"].isin(*OPERATORS)))
    bad = F.exists(entries, lambda e: F.when(
        e["kind"] == "object", F.exists(e["operators"], lambda o: _bad_operand(
            o["key"], o["value"], e["type"]))).otherwise(_misfit(e["value"], e["type"])))
    return issues(issue("filter", F.when(unknown, "not_filterable").when(
        operators, "unknown_operator").when(bad, "bad_value"))).cast(_ERRORS)


def _misfit(value: Column, kind: Column) -> Column:
    """Whether a scalar (other than null) cannot be compared with a field of the type ``kind``."""
    is_a, text = kind_of(value), F.try_variant_get(value, "$", "string")
    number = text.try_cast("decimal(38,9)")
    whole = F.coalesce(number.between(
        F.when(kind == "int", F.lit(-2 ** 31)).otherwise(F.lit(-2 ** 63)),
        F.when(kind == "int", F.lit(2 ** 31 - 1)).otherwise(F.lit(2 ** 63 - 1))), F.lit(False))
    fits = (F.when(is_a.isin("object", "array", "boolean"), is_a == kind)
            .when(kind == "string", is_a == "string")
            .when(kind == "timestamp", (is_a == "string") & text.try_cast("timestamp").isNotNull())
            .when(kind.isin("int", "bigint"), whole)
            .otherwise(text.try_cast("double").isNotNull()))
    return (is_a != "void") & ~fits


def _bad_operand(operator: Column, value: Column, kind: Column) -> Column:
    """Whether the value of an operator does not fit the field or the operator."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return (F.when(operator.isin("in", "not_in"), (F.coalesce(F.size(items), F.lit(0)) <= 0)
                   | F.coalesce(F.exists(items, lambda v: _misfit(v, kind)), F.lit(False)))
            .when(operator == "is_null", kind_of(value) != "boolean")
            .when(operator == "contains", (kind != "string") | (kind_of(value) != "string"))
            .otherwise(_misfit(value, kind)))


def validate_submissions(submissions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Check requests before anything runs; adds ``errors``.

    Columns: ``account_id, entity_type, action_type, payload`` (JSON text), ``batch_size,
    idempotency_key, scheduled_at, created_at``. Entities and actions are those registered. The
    contents of a filter and of an update (names, operators, values by the entity's declaration)
    are looked at when everything else about the request is right.
    """
    entities, actions = all_entities(), all_actions()
    known = accounts.select(F.col("account_id").alias("_known"))
    joined = submissions.join(known, F.col("account_id") == F.col("_known"), "left")

    entity, action = type_name("entity_type"), type_name("action_type")
    # The payload is parsed once; its parts are taken from that in projections of their own.
    joined = joined.withColumn("_v", F.try_parse_json("payload"))
    parts = {"filter": "filter", "ids": "entity_ids", "dedup": "deduplicate_by", "hard": "hard",
             "updates": "updates"}
    joined = joined.withColumns({"_keys": members("_v"), "_entity": entity, "_action": action,
                                 **{f"_p_{n}": member("_v", name) for n, name in parts.items()}})
    joined = joined.withColumns({f"_k_{n}": kind_of(f"_p_{n}") for n in ("filter", "ids", "updates")})
    joined = joined.withColumns({
        "_has_filter": F.coalesce(F.col("_k_filter") != "void", F.lit(False)),
        "_has_ids": F.coalesce(F.col("_k_ids") != "void", F.lit(False)),
        "_dedup": F.try_variant_get("_p_dedup", "$", "string"),
        "_hard": F.coalesce(F.try_variant_get("_p_hard", "$", "string") == "true", F.lit(False)),
        "_ids": F.size(F.try_variant_get("_p_ids", "$", "array<variant>")),
        "_sent": F.when(F.col("_k_updates") != "void", F.col("_k_updates")),
        "_sent_names": members("_p_updates")})
    entity, action, keys = F.col("_entity"), F.col("_action"), F.col("_keys")
    allowed_keys = _lookup(
        {n: [*a.params, "filter", "entity_ids", "deduplicate_by"] for n, a in actions.items()},
        action, "array<string>")
    required_keys = _lookup({n: list(a.required) for n, a in actions.items()}, action,
                            "array<string>")
    supported = _lookup(
        {n: [e for e in entities if a.supported(e)] or ["-"] for n, a in actions.items()},
        action, "array<string>")
    dedup_fields = _lookup({n: list(e.dedup_fields) or ["-"] for n, e in entities.items()},
                           entity, "array<string>")
    soft = _lookup({n: e.soft_delete is not None for n, e in entities.items()}, entity, "boolean")
    has_filter, has_ids = F.col("_has_filter"), F.col("_has_ids")
    dedup_by, hard = F.col("_dedup"), F.col("_hard")
    known_entity = entity.isin(*entities)
    known_action = action.isin(*actions)
    errors = issues(
        issue("account_id", when_true(F.col("_known").isNull(), "unknown_account")),
        issue("entity_type", when_true(~known_entity, "unknown_entity")),
        issue("action_type", F.when(~known_action, "unknown_action")
              .when(known_entity & ~F.array_contains(supported, entity), "unsupported_pair")),
        issue("payload", F.when(keys.isNull(), "not_an_object")
              .when(known_action & (F.size(F.array_except(keys, allowed_keys)) > 0),
                    "unknown_key")
              .when(known_action & (F.size(F.array_except(required_keys, keys)) > 0),
                    "missing_key")),
        issue("filter", F.when(keys.isNotNull() & ~has_filter & ~has_ids, "no_target_set")
              .when(has_filter & has_ids, "two_target_sets")
              .when(has_filter & (F.col("_k_filter") != "object"), "not_an_object")),
        issue("entity_ids", F.when(has_ids & (F.col("_k_ids") != "array"), "not_a_list")
              .when(has_ids & (F.col("_ids") == 0), "empty")),
        issue("deduplicate_by", when_true(
            dedup_by.isNotNull() & known_entity & ~F.array_contains(dedup_fields, dedup_by),
            "not_a_dedup_field")),
        issue("hard", when_true((action == "delete") & known_entity & ~soft & ~hard,
                                "no_soft_delete_column")),
        issue("updates", F.when(F.size("_sent_names") == 0, "empty")
              .when(F.col("_sent") != "object", "not_an_object")),
        issue("batch_size", when_true(~F.col("batch_size").between(1, MAX_BATCH_SIZE),
                                      "out_of_range")),
        issue("idempotency_key", when_true(
            F.char_length("idempotency_key") > MAX_IDEMPOTENCY_KEY_LENGTH, "too_long")),
        issue("scheduled_at", when_true(F.col("scheduled_at") <= F.col("created_at"),
                                        "not_in_future")),
    )
    checked = joined.withColumns({
        "_errors": errors,
        "_updates": F.try_variant_get("_p_updates", "$", "map<string,string>"),
        "_filter": F.try_variant_get("_p_filter", "$", "map<string,variant>")})
    none = F.array().cast(_ERRORS)
    own = [F.coalesce(F.when(action == name, issues(*(
        issue(field, error) for field, error in a.column_check(F.col("_v")))).cast(_ERRORS)), none)
        for name, a in actions.items() if a.column_check]
    contents = F.concat(
        *own, F.coalesce(_filter_errors(entities, entity, F.col("_filter")), none),
        F.coalesce(F.when(action == "update", _update_errors(
            entities, entity, F.col("_updates"))), none))
    return checked.select(*submissions.columns, F.when(F.size("_errors") > 0, F.col("_errors"))
                          .otherwise(contents).alias("errors"))


def validate_accounts(accounts: DataFrame) -> DataFrame:
    """Account rules: name of 1 to 255 characters, limit within bounds."""
    limit = F.col("rate_limit_per_minute")
    return accounts.withColumn("errors", issues(
        issue("name", F.when(F.col("name").isNull() | (F.char_length("name") < 1), "too_short")
              .when(F.char_length("name") > 255, "too_long")),
        issue("rate_limit_per_minute",
              F.when(limit.isNull() | (limit < 1), "below_minimum")
              .when(limit > MAX_RATE_LIMIT_PER_MINUTE, "above_maximum"))))


def validate_seed_requests(requests: DataFrame) -> DataFrame:
    """Seed rules: row count and duplicate ratio within bounds."""
    return requests.withColumn("errors", issues(
        issue("count", when_true(~F.col("count").between(1, MAX_SEED_ROWS), "out_of_range")),
        issue("duplicate_ratio", when_true(
            ~F.col("duplicate_ratio").between(0, MAX_DUPLICATE_RATIO), "out_of_range"))))


def error_text(errors: Column | str = "errors") -> Column:
    """Error list as one sorted text, for reports."""
    c = F.col(errors) if isinstance(errors, str) else errors
    return F.array_join(F.array_sort(F.transform(
        c, lambda e: F.concat(e["field"], F.lit(":"), e["error"]))), ";")


def mark_replays(submissions: DataFrame, existing: DataFrame | None = None, pk: str = "id"
                 ) -> DataFrame:
    """Flag repeated submissions: adds ``replay_of``, the id of the action that already holds the
    ``(account_id, idempotency_key)``, or null for a submission that creates its own.

    ``existing`` holds stored actions. The first submission by ``(created_at, id)`` wins; a null
    or empty key never matches anything.
    """
    keyed = submissions.withColumn("_key", F.nullif(F.col("idempotency_key"), F.lit("")))
    owners = (keyed.where(F.col("_key").isNotNull()).groupBy("account_id", "_key")
              .agg(F.min(F.struct("created_at", pk)).alias("_first"))
              .select(F.col("account_id").alias("_account"), F.col("_key").alias("_owner_key"),
                      F.col(f"_first.{pk}").alias("_owner")))
    if existing is not None:
        stored = existing.where(F.col("idempotency_key") != "").select(
            F.col("account_id").alias("_stored_account"),
            F.col("idempotency_key").alias("_stored_key"), F.col(pk).alias("_stored"))
        owners = owners.join(stored, (F.col("_account") == F.col("_stored_account"))
                             & (F.col("_owner_key") == F.col("_stored_key")), "left").select(
            "_account", "_owner_key", F.coalesce("_stored", "_owner").alias("_owner"))
    # One owner per key: when a key is hot, AQE splits its submissions over several tasks.
    joined = keyed.join(owners, (F.col("account_id") == F.col("_account"))
                        & (F.col("_key") == F.col("_owner_key")), "left")
    return joined.select(
        *submissions.columns,
        F.when(F.col("_owner") != F.col(pk), F.col("_owner")).alias("replay_of"))


def first_submissions(submissions: DataFrame, pk: str = "id") -> DataFrame:
    """One submission per ``(account_id, idempotency_key)``; those without a key all stay."""
    keyed = submissions.withColumn("_key", F.nullif(F.col("idempotency_key"), F.lit("")))
    return (mark_first(keyed, ["account_id", "_key"], ["created_at"], pk, "_first")
            .where("_first").drop("_first", "_key"))


def initial_status(submissions: DataFrame) -> DataFrame:
    """Status at acceptance; a schedule that is not in the future is an error. Times without a
    zone are UTC (the session time zone is expected to be UTC)."""
    late = F.col("scheduled_at") <= F.col("created_at")
    return submissions.withColumns({
        "status": F.when(F.col("scheduled_at").isNull(), "queued").when(~late, "scheduled"),
        "error": F.when(late, "scheduled_at_not_in_future")})


def due(actions: DataFrame, as_of: Column) -> DataFrame:
    """Scheduled actions whose time has come."""
    return actions.where((F.col("status") == "scheduled") & (F.col("scheduled_at") <= as_of))


def with_batch_size(submissions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Batch size each submission will really use, given its account's limit (of an account that
    is not known: the requested size, clamped to the maximum)."""
    limits = accounts.select("account_id", "rate_limit_per_minute")
    return submissions.join(limits, "account_id", "left").withColumn(
        "effective_batch_size", effective_batch_size("batch_size", "rate_limit_per_minute"))


def accept_submissions(submissions: DataFrame, accounts: DataFrame,
                       existing: DataFrame | None = None, pk: str = "id",
                       per_minute: int = DEFAULT_SUBMISSIONS_PER_MINUTE) -> DataFrame:
    """Decide a table of requests as if they arrived one by one: adds ``errors``, ``replay_of``,
    ``decision`` (rejected / replayed / rate_limited / accepted), ``retry_after_seconds``,
    ``status`` and ``effective_batch_size``.

    A request replays the accepted one that holds its key and then costs nothing, whatever its
    payload: only its account, batch size and key length are looked at before. A request that
    was denied holds no key, so the next one with that key tries again. Which requests try depends
    on who was admitted and the other way round. This starts from "the first of each key is
    admitted" and repeats until assumption and outcome agree, which is the one-by-one result;
    usually that is at once, since only denied requests can change it.
    """
    # Several readers follow, so the checked requests are written once.
    checked = stage(validate_submissions(submissions, accounts), "requests")
    bad = checked.where(F.size("errors") > 0).withColumns({
        "_key": F.nullif(F.col("idempotency_key"), F.lit("")),
        "_at": F.struct("created_at", pk)})
    envelope = F.exists("errors", lambda e: e["field"].isin(
        "account_id", "batch_size", "idempotency_key"))
    valid = checked.where(F.size("errors") == 0).withColumns({
        "_key": F.nullif(F.col("idempotency_key"), F.lit("")),
        "_at": F.struct("created_at", pk)})
    replayed = []
    if existing is not None:
        stored = existing.where(F.col("idempotency_key") != "").select(
            "account_id", F.col("idempotency_key").alias("_key"), F.col(pk).alias("replay_of"))
        known = valid.join(stored, ["account_id", "_key"], "left")
        replayed.append(known.where(F.col("replay_of").isNotNull()))
        valid = known.where(F.col("replay_of").isNull()).drop("replay_of")
        bad = bad.join(stored, ["account_id", "_key"], "left")
    else:
        bad = bad.withColumn("replay_of", F.lit(None).cast(checked.schema[pk].dataType))

    def by_key(rows: DataFrame) -> DataFrame:
        return (rows.where(F.col("_key").isNotNull()).groupBy("account_id", "_key")
                .agg(F.min("_at").alias("_holder")))

    holders = by_key(valid)
    while True:
        keyed = valid.join(holders, ["account_id", "_key"], "left")
        tries = keyed.where(F.col("_holder").isNull() | (F.col("_at") <= F.col("_holder")))
        decided = stage(submission_limit(tries.drop("_holder"), ["created_at", pk], "created_at",
                                         per_minute=per_minute), "decided")
        denied = decided.where(~F.col("allowed") & F.col("_key").isNotNull())
        if denied.isEmpty():
            break
        admitted = stage(by_key(decided.where("allowed")), "holders")
        changed = holders.join(admitted.withColumnRenamed("_holder", "_now"),
                               ["account_id", "_key"], "full")
        if changed.where(~F.col("_holder").eqNullSafe(F.col("_now"))).isEmpty():
            break
        holders = admitted

    replayed.append(keyed.where(F.col("_at") > F.col("_holder")).select(
        *valid.columns, F.col(f"_holder.{pk}").alias("replay_of")))
    bad = bad.join(holders, ["account_id", "_key"], "left")
    held = F.when(F.col("_at") > F.col("_holder"), F.col(f"_holder.{pk}"))
    bad = bad.withColumn("replay_of", F.when(~envelope, F.coalesce("replay_of", held)))
    replayed.append(bad.where(F.col("replay_of").isNotNull()))
    rejected = bad.where(F.col("replay_of").isNull()).select(
        *checked.columns, F.lit("rejected").alias("decision"))
    status = F.when(F.col("scheduled_at").isNull(), "queued").otherwise("scheduled")
    fresh = with_batch_size(decided, accounts).select(
        *checked.columns,
        F.when(F.col("allowed"), "accepted").otherwise("rate_limited").alias("decision"),
        "retry_after_seconds", F.when(F.col("allowed"), status).alias("status"),
        F.when(F.col("allowed"), F.col("effective_batch_size")).alias("effective_batch_size"))
    out = fresh.unionByName(rejected, allowMissingColumns=True)
    for rows in replayed:
        rows = rows.select(*checked.columns, "replay_of", F.lit("replayed").alias("decision"))
        out = out.unionByName(rows, allowMissingColumns=True)
    return out
