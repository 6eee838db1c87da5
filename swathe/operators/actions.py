"""Actions: what happens to the rows of a target set, stated as Column expressions.

An action is a function ``(entity, params, df) -> Mutation``. Everything else (selection, batches,
duplicates, audit rows, counters) is shared, so a new action is one registered function.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.functions.predicates import check_filter
from swathe.model import ActionSpec, EntitySpec, RequestError, all_entities


@dataclass(frozen=True)
class Mutation:
    """Effect on one row.

    ``assign`` maps columns to their new values, ``remove`` drops the row instead, ``unchanged``
    is true for rows that already look as requested, ``details`` is the JSON kept in the audit row.
    ``details`` is taken as constant over the action, so it is not carried through shuffles; set
    ``row_details`` when it reads columns of the row.
    """

    assign: Mapping[str, Column] = field(default_factory=dict)
    remove: bool = False
    unchanged: Column | None = None
    reason: str = "updated"
    details: Column | None = None
    row_details: bool = False
    stamp: bool = True


@dataclass(frozen=True)
class Action:
    name: str
    build: Callable[[EntitySpec, Mapping[str, Any], DataFrame], Mutation]
    params: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    supports: tuple[str, ...] | str = "*"
    check: Callable[[EntitySpec, Mapping[str, Any]], Mapping[str, Any]] | None = None
    # The same check over a table of requests: (field, error) columns from the payload (a VARIANT);
    # an error is null where there is none.
    column_check: Callable[[Column], Sequence[tuple[str, Column]]] | None = None
    include_deleted: bool = False
    description: str = ""

    def supported(self, entity: str) -> bool:
        return self.supports == "*" or entity in self.supports


_actions: dict[str, Action] = {}


def register_action(name: str, **options: Any) -> Callable:
    """Decorator: make ``fn(entity, params, df) -> Mutation`` available as an action."""
    def add(fn: Callable) -> Callable:
        if name in _actions:
            raise RuntimeError(f"action {name!r} is already registered")
        _actions[name] = Action(name, fn, **options)
        return fn
    return add


def get_action(name: str, entity: str | None = None) -> Action:
    key = name.strip().lower()
    if key not in _actions:
        raise RequestError(f"Unknown action {name!r}; registered: {sorted(_actions)}")
    action = _actions[key]
    if entity is not None and not action.supported(entity):
        raise RequestError(f"Action {key!r} does not support entity {entity!r}")
    return action


def all_actions() -> dict[str, Action]:
    return dict(_actions)


def entity_action_matrix(spark: SparkSession) -> DataFrame:
    """Supported (entity, action) pairs: each entity with its supported actions, unnested."""
    rows = [(e, [a for a in sorted(_actions) if _actions[a].supported(e)])
            for e in sorted(all_entities())]
    frame = spark.createDataFrame(rows, "entity_type string, actions array<string>")
    return frame.select("entity_type", F.explode("actions").alias("action_type"))


def check_spec(entity: EntitySpec, spec: ActionSpec, columns: list[str]) -> Mapping[str, Any]:
    """Refuse a request that must not run; return its parameters in declared types."""
    action = get_action(spec.action, entity.name)
    absent = [c for c in (entity.pk, entity.account) if c not in columns]
    if absent:
        raise RequestError(f"The table has no column {absent}")
    if spec.filter is None and spec.ids is None:
        raise RequestError("Give a filter or ids; an empty filter means the whole account.",
                           [{"field": "filter", "error": "no_target_set"}])
    if spec.filter is not None and spec.ids is not None:
        raise RequestError("Give a filter or ids, not both.",
                           [{"field": "filter", "error": "two_target_sets"}])
    if isinstance(spec.ids, (list, tuple)) and not spec.ids:
        raise RequestError("The id list is empty.", [{"field": "entity_ids", "error": "empty"}])
    unknown = sorted(set(spec.params) - set(action.params))
    if unknown:
        raise RequestError(f"Unknown parameters {unknown} for action {action.name!r}",
                           [{"field": n, "error": "unknown_key"} for n in unknown])
    absent = [n for n in action.required if n not in spec.params]
    if absent:
        raise RequestError(f"Action {action.name!r} needs {absent}",
                           [{"field": n, "error": "missing"} for n in absent])
    params = action.check(entity, spec.params) if action.check else spec.params
    check_filter(entity, spec.filter, columns)
    if spec.dedup_by and spec.dedup_by not in entity.dedup_fields:
        raise RequestError(f"{spec.dedup_by!r} does not identify duplicates of {entity.name!r}; "
                           f"declared: {sorted(entity.dedup_fields)}",
                           [{"field": "deduplicate_by", "error": "not_a_dedup_field"}])
    return params


def duplicate_reason(field_name: str) -> str:
    return "duplicate_email" if field_name == "email" else "duplicate_key"


# --- shipped actions ------------------------------------------------------------------------

def _check_update(entity: EntitySpec, params: Mapping[str, Any]) -> Mapping[str, Any]:
    return {**params, "updates": entity.coerce_updates(params["updates"])}


@register_action("update", params=("updates",), required=("updates",), check=_check_update,
                 description="Set fields to the same values on every row of the target set.")
def update(entity: EntitySpec, params: Mapping[str, Any], df: DataFrame) -> Mutation:
    absent = sorted(set(params["updates"]) - set(df.columns))
    if absent:
        raise RequestError(f"The table has no column {absent}")
    assign = {n: F.lit(v).cast(df.schema[n].dataType) for n, v in params["updates"].items()}
    unchanged = reduce(lambda a, b: a & b,
                       (F.col(n).eqNullSafe(v) for n, v in assign.items()))
    values = F.struct(*[v.alias(n) for n, v in assign.items()])
    return Mutation(assign, unchanged=unchanged, reason="updated",
                    details=F.to_json(F.struct(values.alias("updates")),
                                      {"ignoreNullFields": "false"}))


def _check_delete(entity: EntitySpec, params: Mapping[str, Any]) -> Mapping[str, Any]:
    hard = params.get("hard", False)
    if not isinstance(hard, bool):
        raise RequestError("hard is a boolean", [{"field": "hard", "error": "not_a_boolean"}])
    if not hard and entity.soft_delete is None:
        raise RequestError(f"{entity.name!r} has no soft-delete column; use hard",
                           [{"field": "hard", "error": "no_soft_delete_column"}])
    return {"hard": hard}


@register_action("delete", params=("hard",), check=_check_delete,
                 description="Mark every row of the target set as deleted, or remove it (hard).")
def delete(entity: EntitySpec, params: Mapping[str, Any], df: DataFrame) -> Mutation:
    details = F.to_json(F.struct(F.lit(params["hard"]).alias("hard")))
    if params["hard"]:
        return Mutation(remove=True, reason="deleted", details=details)
    return Mutation({entity.soft_delete: F.col("_as_of")}, reason="deleted", details=details)


def _check_archive(entity: EntitySpec, params: Mapping[str, Any]) -> Mapping[str, Any]:
    column = params.get("column", "status")
    checked = entity.coerce_updates({column: params.get("status", "archived")})
    return {"column": column, "status": checked[column]}


@register_action("archive", params=("status", "column"), check=_check_archive,
                 description="Move rows to an archived status, whatever they were before.")
def archive(entity: EntitySpec, params: Mapping[str, Any], df: DataFrame) -> Mutation:
    return Mutation({params["column"]: F.lit(params["status"])}, reason="updated")


def _check_tag(entity: EntitySpec, params: Mapping[str, Any]) -> Mapping[str, Any]:
    suffix, column = params["suffix"], params.get("column", "name")
    if not isinstance(suffix, str) or not 1 <= len(suffix) <= 20:
        raise RequestError("suffix is a text of 1 to 20 characters",
                           [{"field": "suffix", "error": "length"}])
    if column not in entity.fields:
        raise RequestError(f"{column!r} cannot be updated on {entity.name!r}",
                           [{"field": "column", "error": "not_updatable"}])
    return {"suffix": suffix, "column": column}


def _tag_errors(payload: Column) -> list[tuple[str, Column]]:
    suffix = F.try_variant_get(payload, "$.suffix", "variant")
    text = F.when(F.schema_of_variant(suffix) == "STRING", F.try_variant_get(suffix, "$", "string"))
    fits = F.coalesce(F.char_length(text).between(1, 20), F.lit(False))
    return [("suffix", F.when(~fits, "length"))]


@register_action("tag", params=("suffix", "column"), required=("suffix",), check=_check_tag,
                 column_check=_tag_errors,
                 description="Append a suffix to the name.")
def tag(entity: EntitySpec, params: Mapping[str, Any], df: DataFrame) -> Mutation:
    column = params["column"]
    return Mutation({column: F.concat(F.col(column), F.lit(params["suffix"]))}, reason="updated",
                    stamp=False)
