"""Whole bulk actions for a table of submissions: what one request at a time would do, in one job.

:func:`swathe.plans.bulk.run_action` runs one request. Here many requests of many accounts arrive
together, each with its filter or ids, its action, fields, de-duplication and batch size. They are
compiled to typed rows (conditions, new values) and evaluated in one scan: every row of an account
meets the account's requests in arrival order, each seeing what the ones before left of the row.

* A row does not meet all requests. Per account there is an inverted index of their equality
  conditions: a request that asks for a value of a field is found by rows with that value, as long as
  no request of the account writes the field in the same round. Requests with ids are found through a
  join of the ids. Only what is left is met by every row of the account.
* The effect of an update, delete, archive or tag on a row depends on that row alone, so a run of such
  requests is one fold per row. De-duplication looks at other rows: a request with it ends its
  account's run, and its first rows per key are found over all rows. The job takes as many rounds as
  the account with most such requests has of them.
* A request keeps its audit rows, batches and statistics; batches are numbered over all rows a request
  met, however many they are.

Requests are bounded by the caller (a trigger's), rows are not: what travels is one small row per
account and round, and the rows that some request met.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathe.functions.conditions import (
    holds,
    kind_of,
    member,
    members,
    slots_of,
    with_conditions,
)
from swathe.functions.measures import effective_batch_size
from swathe.functions.rules import coerced, field_error
from swathe.functions.text import normalise_key, type_name
from swathe.model import DEFAULT_RATE_LIMIT_PER_MINUTE, EntitySpec
from swathe.operators.accounting import (
    action_counters,
    action_stats,
    batch_counts,
    reason_breakdown,
)
from swathe.operators.ordered import rank_within
from swathe.plans.bulk import MESSAGES
from swathe.sources.staging import stage

SHIPPED = ("update", "delete", "archive", "tag")
RUN = 500  # requests of one account that a row may meet in a round


@dataclass(frozen=True)
class Arrivals:
    """What a table of submissions did.

    ``touched`` has all columns and ``_gone`` of every row that some request changed; ``changes``
    has these and the earlier changes that were given, and :func:`with_changes` lays it over the
    table. ``rejected`` has the requests that were not run, with their errors.
    """

    outcomes: DataFrame
    batches: DataFrame
    stats: DataFrame
    changes: DataFrame
    touched: DataFrame
    claims: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class Slots:
    """What a round's requests ask for (condition slots by field) and write (fields, by value and by
    suffix; the marker of soft deletes). The fold of a row is interpreted, so what no request of the
    round has is left out of it."""

    asked: dict[str, frozenset[str]]
    given: frozenset[str]
    suffixed: frozenset[str]
    soft: bool


# --- requests as rows -----------------------------------------------------------------------

def compile_requests(submissions: DataFrame, entity: EntitySpec, schema: T.StructType
                     ) -> DataFrame:
    """Typed requests: conditions, effects and ``errors`` per row of ``submissions`` (action_id,
    account_id, action_type, configuration, created_at; optional batch_size and
    rate_limit_per_minute). The JSON is parsed once."""
    writable = [n for n in entity.fields if n in schema.names]
    given, key = submissions.columns, schema[entity.pk].dataType.simpleString()

    def text(value: Column) -> Column:
        return F.try_variant_get(value, "$", "string")

    action, column = F.col("_action"), F.col("_column")
    size = F.col("batch_size") if "batch_size" in given else F.lit(None).cast("long")
    limit = (F.col("rate_limit_per_minute") if "rate_limit_per_minute" in given
             else F.lit(DEFAULT_RATE_LIMIT_PER_MINUTE))
    rows = submissions.withColumns({
        "_body": F.try_parse_json("configuration"), "_action": type_name("action_type"),
        "_size": effective_batch_size(size, limit)})
    rows = rows.withColumns({f"_{n}": member("_body", n) for n in (
        "filter", "entity_ids", "deduplicate_by", "updates", "hard", "suffix", "column", "status")})
    # A filter of null is no filter.
    rows = rows.withColumns({n: F.when(kind_of(n) != "void", F.col(n))
                             for n in ("_filter", "_entity_ids")})
    rows = with_conditions(rows, entity, schema, "_filter").withColumns({
        "_is_body": F.coalesce(kind_of("_body") == "object", F.lit(False)),
        "_filter_kind": kind_of("_filter"), "_ids_kind": kind_of("_entity_ids"),
        "_ids": F.transform(F.try_variant_get("_entity_ids", "$", "array<variant>"),
                            lambda v: F.try_variant_get(v, "$", key)),
        "_dedup": text(F.col("_deduplicate_by")), "_sent": members("_updates"),
        "_hard_given": F.col("_hard").isNotNull(),
        "_hard": F.try_variant_get("_hard", "$", "boolean"), "_suffix": text(F.col("_suffix")),
        "_status": F.coalesce(text(F.col("_status")), F.lit("archived")),
        "_column": F.coalesce(text(F.col("_column")), F.when(action == "archive", "status").when(
            action == "tag", "name")),
        **{f"_u_{n}": F.when(action == "update", member("_updates", n)) for n in writable}})
    rows = rows.withColumns({f"_k_{n}": kind_of(f"_u_{n}") for n in writable})
    rows = rows.withColumns({
        **{f"_raw_{n}": F.when((action == "archive") & (column == n), F.col("_status")).otherwise(
            text(F.col(f"_u_{n}"))) for n in writable},
        **{f"_given_{n}": F.col(f"_u_{n}").isNotNull() | F.coalesce(
            (action == "archive") & (column == n), F.lit(False)) for n in writable}})

    errors, effects = [], []
    for name in writable:
        rule, kind, raw = entity.fields[name], schema[name].dataType, F.col(f"_raw_{name}")
        asked = F.col(f"_given_{name}")
        wrong = field_error(raw, rule)
        if rule.type == "string":
            wrong = F.when(~F.col(f"_k_{name}").isin("string", "void"), "not_a_string").otherwise(wrong)
        errors.append(F.when(asked & wrong.isNotNull(), F.concat(F.lit(f"{name}:"), wrong)))
        suffix = F.when((action == "tag") & (column == name), F.col("_suffix"))
        effects.append(F.struct(asked.alias("given"), coerced(raw, rule).cast(kind).alias("value"),
                                suffix.alias("suffix")).alias(name))
    is_update, misfits = action == "update", F.col("misfits")
    errors += [
        F.when(~action.isin(*SHIPPED), "action_type:needs_its_own_run"),
        F.when(~F.col("_is_body"), "configuration:not_an_object"),
        F.when(F.col("_filter").isNull() & F.col("_entity_ids").isNull(), "filter:no_target_set")
        .when(F.col("_filter").isNotNull() & F.col("_entity_ids").isNotNull(),
              "filter:two_target_sets")
        .when(F.col("_filter_kind") != "object", "filter:not_an_object")
        .when(F.size(misfits) > 0, F.concat(F.lit("filter:"), F.array_join(misfits, ","))),
        F.when((F.col("_ids_kind") != "array") | (F.size("_ids") == 0), "entity_ids:empty"),
        F.when(is_update & (F.coalesce(F.size("_sent"), F.lit(0)) <= 0), "updates:empty")
        .when(is_update & F.exists("_sent", lambda n: ~n.isin(*writable)), "updates:not_updatable"),
        F.when(action.isin("archive", "tag") & ~column.isin(*writable), "column:not_updatable"),
        F.when((action == "tag") & ~F.coalesce(F.char_length("_suffix").between(1, 20),
                                               F.lit(False)), "suffix:length"),
        F.when((action == "delete") & F.col("_hard_given") & F.col("_hard").isNull(),
               "hard:not_a_boolean"),
        F.when(F.col("_dedup").isNotNull() & ~F.col("_dedup").isin(*entity.dedup_fields),
               "deduplicate_by:not_a_dedup_field")]
    if entity.soft_delete not in schema.names:
        errors.append(F.when((action == "delete") & ~F.coalesce("_hard", F.lit(False)),
                             "hard:no_soft_delete_column"))
    # Values as they were sent, in the order of the declaration, for the audit rows.
    values = F.array_compact(F.array(*[F.when(F.col(f"_e.{n}.given"), F.concat(
        F.lit(f'"{n}":'), _json(F.col(f"_e.{n}.value")))) for n in writable]))
    details = F.when(action == "update", F.concat(
        F.lit('{"updates":{'), F.array_join(values, ","), F.lit("}}"))).when(
        action == "delete", F.concat(F.lit('{"hard":'), F.coalesce("_hard", F.lit(False)).cast(
            "string"), F.lit("}")))
    rows = rows.withColumn("_e", F.struct(*effects))
    return rows.select(
        "action_id", F.col("account_id").cast(schema[entity.account].dataType).alias("account"),
        action.alias("action"), "created_at", F.col("_size").alias("size"),
        "conds", F.col("_filter").isNotNull().alias("by_filter"), F.col("_ids").alias("ids"),
        F.col("_dedup").alias("dedup"), F.col("_e").alias("effects"),
        F.when(action == "delete", F.coalesce("_hard", F.lit(False))).alias("hard"),
        details.alias("details"),
        F.array_compact(F.array(*errors)).cast("array<string>").alias("errors"))


def _json(value: Column) -> Column:
    """A scalar as JSON text."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(text, F.lit(6), F.length(text) - 6)


def _numbered(requests: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Requests with ``no``, their round and their place in it: a round of an account ends with a
    request with de-duplication, or after ``RUN`` requests."""
    order = [*order_by, "action_id"]
    own = Window.partitionBy("account").orderBy(*order)  # a trigger's requests of one account
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumns({
        "_ended": F.coalesce(F.count("dedup").over(before), F.lit(0)),
        "_seen": F.row_number().over(own)})
    part = F.row_number().over(Window.partitionBy("account", "_ended").orderBy(*order)) - 1
    rows = rows.withColumn("_part", F.floor(part / RUN))
    rows = rows.withColumn("round", F.dense_rank().over(
        Window.partitionBy("account").orderBy("_ended", "_part")) - 1)
    place = F.row_number().over(Window.partitionBy("account", "round").orderBy("_seen")) - 1
    return rows.withColumns({"place": place, "no": F.xxhash64("account", "action_id")}).drop(
        "_ended", "_part", "_seen")


def _slots(requests: DataFrame, entity: EntitySpec, schema: T.StructType) -> list[Slots]:
    """:class:`Slots` of every round, from one row per round."""
    names = entity.filterable(schema.names)
    conds = {(n, op): F.col(f"conds.{n}.{op}") for n in names for op in slots_of(schema, n)}
    tests = {k: c if k[1] == "never" else c.isNotNull() for k, c in conds.items()}
    writable = [n for n in entity.fields if n in schema.names]
    tests |= {("given", n): F.col(f"effects.{n}.given") for n in writable}
    tests |= {("suffix", n): F.col(f"effects.{n}.suffix").isNotNull() for n in writable}
    tests["soft"] = F.col("hard") == F.lit(False)
    rows = requests.groupBy("round").agg(
        *[F.max(t).alias(f"t{i}") for i, t in enumerate(tests.values())]).collect()
    out = []
    for row in sorted(rows, key=lambda r: r["round"]):
        held = {k for i, k in enumerate(tests) if row[f"t{i}"]}
        out.append(Slots(
            {n: frozenset(op for op in slots_of(schema, n) if (n, op) in held & conds.keys())
             for n in names},
            *[frozenset(n for n in writable if (kind, n) in held) for kind in ("given", "suffix")],
            "soft" in held))
    return out


def _by_account(requests: DataFrame, entity: EntitySpec, schema: T.StructType,
                slots: Slots | None = None) -> DataFrame:
    """One row per account: its requests in order, and the index of their equality conditions."""
    fields = _indexed(entity, schema, slots)
    written = {n: F.max((F.col(f"effects.{n}.given") | F.col(f"effects.{n}.suffix").isNotNull())
                        ).over(Window.partitionBy("account")) if n in entity.fields else F.lit(False)
               for n in fields}
    field = F.coalesce(*[F.when(F.col(f"conds.{n}.eq").isNotNull() & ~written[n], n)
                         for n in fields], F.lit(None).cast("string")) if fields else F.lit(None)
    keyed = requests.select(
        "account", "place", F.when(F.col("by_filter"), F.lit("")).alias("_all"),
        field.cast("string").alias("_field"),
        F.struct("no", "place", "action", "created_at", "conds", "by_filter", "dedup", "effects",
                 "hard").alias("_request"))
    value = F.coalesce(*[F.when(F.col("_field") == n, _key(F.col(f"_request.conds.{n}.eq")))
                         for n in fields], F.lit(None).cast("string")) if fields else F.lit("")
    entries = (keyed.where(F.col("_all").isNotNull())
               .groupBy("account", "_field", F.when(F.col("_field").isNotNull(), value).alias("_v"))
               .agg(F.sort_array(F.collect_list("place")).alias("_places")))
    index = entries.groupBy("account").agg(
        F.flatten(F.collect_list(F.when(F.col("_field").isNull(), F.col("_places")))).alias("_every"),
        *[F.map_from_entries(F.collect_list(F.when(
            F.col("_field") == n, F.struct("_v", "_places")))).alias(f"_index_{n}")
          for n in fields])
    lists = keyed.groupBy("account").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "_request"))), lambda r: r["_request"]
    ).alias("_requests"))
    return lists.join(index, "account", "left")


def _indexed(entity: EntitySpec, schema: T.StructType, slots: Slots | None = None) -> list[str]:
    """Fields whose equality is looked up: text and whole numbers, likely keys first."""
    names = [n for n in entity.filterable(schema.names)
             if isinstance(schema[n].dataType, (T.StringType, T.IntegralType))
             and (slots is None or "eq" in slots.asked[n])]
    return sorted(names, key=lambda n: (n not in entity.dedup_fields, names.index(n)))


def _key(value: Column) -> Column:
    """A value as it stands in the index; numbers that are not whole match no row."""
    return F.regexp_replace(value.cast("string"), r"\.0+$", "")


# --- rows meet requests ---------------------------------------------------------------------

def _effect(entity: EntitySpec, schema: T.StructType, request: Column, row: Column, slots: Slots
            ) -> Column:
    """The row's values after the request."""
    out = []
    for name in schema.names:
        now, kind = row[name], schema[name].dataType
        if name in entity.fields:
            effect, before = request["effects"][name], now
            if isinstance(kind, T.StringType) and name in slots.suffixed:
                now = F.when(effect["suffix"].isNotNull(), F.concat(before, effect["suffix"])
                             ).otherwise(now)
            if name in slots.given:
                now = F.when(effect["given"], effect["value"]).otherwise(now)
        elif name == entity.soft_delete and slots.soft:
            now = F.when(request["hard"] == F.lit(False), request["created_at"].cast(kind)).otherwise(now)
        elif name == entity.updated_at:
            now = F.when(request["action"] != "tag", request["created_at"].cast(kind)).otherwise(now)
        out.append(now.cast(kind).alias(name))
    return F.struct(*out)


def _same(entity: EntitySpec, schema: T.StructType, request: Column, row: Column, slots: Slots
          ) -> Column:
    """Whether an update finds all its values there."""
    tests = [~request["effects"][n]["given"] | row[n].eqNullSafe(request["effects"][n]["value"])
             for n in entity.fields if n in slots.given]
    return reduce(lambda a, b: a & b, tests, request["action"] == "update")


def _meets(entity: EntitySpec, schema: T.StructType, request: Column, row: Column, gone: Column,
           named: Column, slots: Slots) -> Column:
    live = ~gone
    if entity.soft_delete in schema.names:
        live = live & row[entity.soft_delete].isNull()
    names = entity.filterable(schema.names)
    return live & F.when(request["by_filter"], holds(
        request["conds"], schema, names, lambda n: row[n], slots.asked)).otherwise(
        F.coalesce(F.array_contains(named, request["place"]), F.lit(False)))


def _fold(rows: DataFrame, entity: EntitySpec, schema: T.StructType, slots: Slots) -> DataFrame:
    """Rows that some request met, with ``_out``: values, whether gone or changed, and hits (no,
    same) of the requests without de-duplication; and ``no``: the one with it, if met."""
    base = F.struct(*[F.col(n) for n in schema.names])
    start = F.struct(base.alias("row"), F.lit(False).alias("gone"), F.lit(False).alias("changed"),
                     F.array().cast("array<struct<no:long,same:boolean>>").alias("hits"))
    found = [F.coalesce("_every", F.array().cast("array<int>")),
             F.coalesce("_named", F.array().cast("array<int>"))]
    for n in _indexed(entity, schema, slots):
        value = F.col(n).cast("string")
        found.append(F.coalesce(F.when(value.isNotNull(), F.element_at(F.col(f"_index_{n}"), value)),
                                F.array().cast("array<int>")))
    places = F.sort_array(F.array_distinct(F.concat(*found)))

    named, requests = F.col("_named"), F.col("_requests")

    def verdict(state: Column, request: Column) -> Column:
        """0: not met, 1: met with nothing to change, 2: to be changed."""
        meets = _meets(entity, schema, request, state["row"], state["gone"], named, slots)
        return F.when(~(request["dedup"].isNull() & meets), 0).when(
            _same(entity, schema, request, state["row"], slots), 1).otherwise(2)

    def after(state: Column, request: Column, kind: Column) -> Column:
        hard = F.coalesce(request["hard"], F.lit(False))
        return F.struct(
            F.when((kind == 2) & ~hard, _effect(entity, schema, request, state["row"], slots)
                   ).otherwise(state["row"]).alias("row"),
            (state["gone"] | ((kind == 2) & hard)).alias("gone"),
            (state["changed"] | (kind == 2)).alias("changed"),
            F.when(kind > 0, F.concat(state["hits"], F.array(F.struct(
                request["no"].alias("no"), (kind == 1).alias("same"))))).otherwise(
                state["hits"]).alias("hits"))

    def meet(state: Column, place: Column) -> Column:
        return _let(requests[place], lambda request: _let(
            verdict(state, request), lambda kind: after(state, request, kind)))

    def finish(state: Column) -> Column:
        return _let(F.element_at(requests, -1), lambda last: F.struct(
            state["row"].alias("row"), state["gone"].alias("gone"),
            state["changed"].alias("changed"), state["hits"].alias("hits"),
            F.when(last["dedup"].isNotNull() & _meets(entity, schema, last, state["row"],
                                                      state["gone"], named, slots), last["no"]).alias("no")))

    # A generator, not a filter: the optimiser would copy the fold into the filter's condition.
    folded = F.filter(F.array(F.aggregate(places, start, meet, finish)),
                      lambda out: (F.size(out["hits"]) > 0) | out["no"].isNotNull())
    return rows.select(F.col(entity.pk).alias("_pk"), "account", F.explode(folded).alias("_out")
                       ).select("_pk", "account", "_out", "_out.no")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_arrivals(table: DataFrame, entity: EntitySpec, submissions: DataFrame,
                 order_by: Sequence[str] = ("created_at",), changes: DataFrame | None = None
                 ) -> Arrivals:
    """Run the accepted ``submissions`` on ``table`` (with earlier ``changes`` laid over it) in
    ``(*order_by, action_id)`` order per account, as :func:`swathe.plans.bulk.run_action` would one
    by one with ``created_at`` as the time.

    Requests that cannot run (bad JSON, names, values; actions registered by users, whose effect
    is code) are returned in ``rejected``. Action ids are unique within an account. Ids that were
    asked for and met nothing are counted as ``left_target_set`` in their batch.
    """
    schema = table.schema
    columns = table.columns
    every = stage(compile_requests(submissions, entity, schema), "compiled")
    compiled = stage(_numbered(every.where(F.size("errors") == 0), order_by), "requests")
    rejected = every.where(F.size("errors") > 0).select(
        "action_id", F.col("account").alias("account_id"), "errors")
    kind = schema[entity.pk].dataType.simpleString()
    asked = _asked_ids(compiled)
    met, own = [], None
    for number, slots in enumerate(_slots(compiled, entity, schema)):
        requests = compiled.where(F.col("round") == number)
        accounts = _by_account(requests, entity, schema, slots)
        named = (asked.where(F.col("round") == number).groupBy("account", "_pk").agg(
            F.collect_list("place").alias("_named")))
        ours = requests.select(F.col("account").alias(entity.account)).distinct()
        rows = with_changes(table, entity, _over(changes, own, entity.pk)).join(ours, entity.account, "left_semi")
        rows = rows.join(named.select(F.col("account").alias("_a"), "_pk", "_named"),
                         (F.col("_a") == F.col(entity.account)) & (F.col("_pk") == F.col(entity.pk)),
                         "left")
        # The requests come last: they are folded where they are joined and travel no further.
        rows = rows.join(accounts, F.col(entity.account) == F.col("account"))
        folded = stage(_fold(rows, entity, schema, slots), "folded")
        last = _deduplicate(folded, entity, schema, requests, asked, slots)
        met.append(folded.select("account", "_pk", F.inline("_out.hits")).select(
            "account", "_pk", "no", F.when(F.col("same"), "no_change").otherwise("applied").alias(
                "class"), F.lit(None).cast("string").alias("dedup_key")))
        met.append(last.where(F.col("no").isNotNull()).select(
            "account", "_pk", "no", "class", "dedup_key"))
        touched = last.where("changed").select("_row.*", F.col("gone").alias("_gone"))
        own = stage(_over(own, touched.select(*columns, "_gone"), entity.pk), "changes")
    if not met:
        met = [_nothing(table, entity)]
    if own is None:
        own = table.where("false").withColumn("_gone", F.lit(False))
    hits = stage(reduce(DataFrame.unionByName, met), "hits")
    return _accounts_of(hits, compiled, asked, entity, kind,
                        (_over(changes, own, entity.pk), own), rejected)


def _over(before: DataFrame | None, after: DataFrame | None, pk: str) -> DataFrame | None:
    """Changed rows after later changes."""
    if before is None or after is None:
        return before if after is None else after
    return after.unionByName(before.join(after, pk, "left_anti"))


def _nothing(table: DataFrame, entity: EntitySpec) -> DataFrame:
    return table.where("false").select(
        F.col(entity.account).alias("account"), F.col(entity.pk).alias("_pk"),
        F.lit(0).cast("long").alias("no"), F.lit("").alias("class"),
        F.lit("").alias("dedup_key"))


def _asked_ids(requests: DataFrame) -> DataFrame:
    """(no, account, round, place, _pk, batch_index) of requested ids; repeated ones count once, at
    their first position."""
    ids = (requests.where("ids IS NOT NULL")
           .select("no", "account", "round", "place", "size", F.posexplode("ids").alias("_at", "_pk")))
    firsts = ids.groupBy("no", "account", "round", "place", "size", "_pk").agg(
        F.min("_at").alias("_at"))
    ranked = rank_within(firsts, ["no"], ["_at"], "_rank")
    return stage(ranked.withColumn("batch_index", F.expr("(_rank - 1) div size")).drop(
        "_rank", "_at", "size"), "asked")


def _deduplicate(folded: DataFrame, entity: EntitySpec, schema: T.StructType, requests: DataFrame,
                 asked: DataFrame, slots: Slots) -> DataFrame:
    """Rows after the round's last request: _row, gone, changed, and (no, class, dedup_key) where
    the row met it. The first row per (request, key) wins, in batch order; rows without a key
    always pass."""
    keys = []
    for name in entity.dedup_fields:
        if name in schema.names:
            value = F.col(f"_out.row.{name}")
            numeric = isinstance(schema[name].dataType, T.NumericType)
            keys.append(F.when(F.col("_last.dedup") == name,
                               value.cast("string") if numeric else normalise_key(value)))
    key = F.coalesce(*keys, F.lit(None).cast("string"))
    ends = requests.where("dedup IS NOT NULL").select(F.col("no").alias("_no"), F.struct(
        "action", "created_at", "dedup", "effects", "hard").alias("_last"))
    rows = folded.join(ends, F.col("no") == F.col("_no"), "left").withColumn("dedup_key", key)
    batches = asked.select(F.col("no").alias("_n"), F.col("_pk").alias("_p"), "batch_index")
    rows = rows.join(batches, (F.col("no") == F.col("_n")) & (F.col("_pk") == F.col("_p")), "left")
    first = F.min(F.struct(F.coalesce("batch_index", F.lit(0).cast("long")).alias("b"), "_pk"))
    winners = (rows.where(F.col("no").isNotNull() & F.col("dedup_key").isNotNull())
               .groupBy("no", F.unhex(F.md5("dedup_key")).alias("_k"))
               .agg(first.alias("_f")).select(F.col("no").alias("_wn"), F.col("_f._pk").alias("_w")))
    joined = rows.join(winners, (F.col("no") == F.col("_wn")) & (F.col("_pk") == F.col("_w")), "left")
    request, row = F.col("_last"), F.col("_out.row")
    duplicate = F.col("no").isNotNull() & F.col("dedup_key").isNotNull() & F.col("_w").isNull()
    same = _same(entity, schema, request, row, slots)
    kind = F.when(duplicate, "duplicate").when(same, "no_change").otherwise("applied")
    change = F.col("no").isNotNull() & ~duplicate & ~F.coalesce(same, F.lit(False))
    hard = F.coalesce(request["hard"], F.lit(False))
    return joined.select(
        "account", "_pk", "no", kind.alias("class"), "dedup_key",
        F.when(change & ~hard, _effect(entity, schema, request, row, slots)).otherwise(
            row).alias("_row"),
        (F.col("_out.gone") | (change & hard)).alias("gone"),
        (F.col("_out.changed") | change).alias("changed"))


# --- audit rows, batches, statistics --------------------------------------------------------

def _accounts_of(hits: DataFrame, requests: DataFrame, asked: DataFrame, entity: EntitySpec,
                 kind: str, changes: tuple[DataFrame, DataFrame], rejected: DataFrame) -> Arrivals:
    named = asked.select("no", "_pk", "batch_index")
    by_ids = hits.join(named, ["no", "_pk"])
    by_filter = rank_within(
        hits.join(requests.where("by_filter").select("no", "size"), "no"), ["no"], ["_pk"], "_rank"
    ).withColumn("batch_index", F.expr("(_rank - 1) div size"))
    columns = ["no", "_pk", "class", "dedup_key", "batch_index"]
    batched = stage(by_filter.select(*columns).unionByName(by_ids.select(*columns)), "met")

    head = requests.select("no", "action_id", F.col("account").alias("account_id"), "action",
                           "dedup", "details", "created_at")
    rows = batched.join(head, "no")
    field = F.col("dedup")
    applied = F.col("class") == "applied"
    reason = (F.when(applied, F.when(F.col("action") == "delete", "deleted").otherwise("updated"))
              .when(F.col("class") == "no_change", "no_change")
              .when(field == "email", "duplicate_email").otherwise("duplicate_key"))
    outcomes = rows.select(
        "action_id", "account_id", "batch_index", F.col("_pk").alias("entity_id"),
        F.when(applied, "success").otherwise("skipped").alias("status"),
        reason.alias("reason_code"),
        F.when(F.col("class") == "no_change", MESSAGES["no_change"]).when(
            F.col("class") == "duplicate", F.concat(
                F.lit("Another row with the same "), field, F.lit(" was processed first."))
        ).alias("message"),
        F.when(applied, F.col("details")).when(F.col("class") == "duplicate", F.concat(
            F.lit('{"'), field, F.lit('":'), _json(F.col("dedup_key")), F.lit("}"))).alias("details"))

    planned = (batched.join(asked.select("no").distinct(), "no", "left_anti").select(
        "no", "_pk", "batch_index").unionByName(asked.select("no", "_pk", "batch_index")))
    plan = planned.groupBy("no", "batch_index").agg(
        F.min("_pk").alias("cursor_start"), F.max("_pk").alias("cursor_end"),
        F.count("*").alias("entity_count"))
    lost = named.join(hits, ["no", "_pk"], "left_anti").join(head, "no")
    outcomes = stage(outcomes.unionByName(lost.select(
        "action_id", "account_id", "batch_index", F.lit(None).cast(kind).alias("entity_id"),
        F.lit("skipped").alias("status"), F.lit("left_target_set").alias("reason_code"),
        F.lit(MESSAGES["left_target_set"]).alias("message"),
        F.lit(None).cast("string").alias("details"))), "arrival-outcomes")
    owner = ["account_id", "action_id"]
    counts = batch_counts(outcomes, [*owner, "batch_index"])
    batches = (plan.join(head.select("no", *owner), "no").drop("no")
               .join(counts, [*owner, "batch_index"])
               .withColumn("status", F.lit("completed")))
    # Statistics are kept by request number: action ids are unique within an account only.
    number = head.select("no", *owner)
    rename = {"action_id": "_id"}
    numbered = batches.join(number, owner).withColumnsRenamed(rename).withColumnRenamed(
        "no", "action_id")
    breakdown = reason_breakdown(outcomes.join(number, owner).withColumnsRenamed(
        rename).withColumnRenamed("no", "action_id"))
    actions = head.select(
        F.col("no").alias("action_id"), F.lit(entity.name).alias("entity_type"),
        F.col("action").alias("action_type"),
        F.col("created_at").cast("timestamp").alias("started_at"),
        F.col("created_at").cast("timestamp").alias("finished_at"))
    stats = (action_stats(actions, action_counters(numbered), breakdown)
             .withColumnRenamed("action_id", "no").join(number, "no").drop("no"))
    claims = rows.where((F.col("class") != "duplicate") & F.col("dedup_key").isNotNull()).select(
        *owner, "dedup_key", F.col("_pk").alias("winner_pk"))
    return Arrivals(outcomes, batches, stats, *changes, claims, rejected)


def with_changes(table: DataFrame, entity: EntitySpec, changes: DataFrame | None) -> DataFrame:
    """``table`` as it is after ``changes``."""
    if changes is None:
        return table
    kept = table.join(changes.select(entity.pk), entity.pk, "left_anti")
    return kept.unionByName(changes.where("NOT _gone").select(*table.columns))
