"""One bulk action as a Spark job: select, batch, de-duplicate, act, audit, count."""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.functions.measures import batch_size_of
from swathe.model import ActionSpec, EntitySpec, RequestError
from swathe.operators.accounting import (
    batch_counts,
    failed_batch_rows,
    outcome_counts,
    single_action_stats,
)
from swathe.operators.actions import Mutation, check_spec, duplicate_reason, get_action
from swathe.operators.batching import (
    assign_batches,
    assign_ids,
    drift_rows,
    resolve_batches,
    summarise_batches,
)
from swathe.operators.dedup import DUPLICATE, UNIQUE, claimed_keys, mark_duplicates
from swathe.operators.mutate import account_slice, mutate, mutate_keys
from swathe.operators.targets import ids_frame, in_scope, target_predicate
from swathe.operators.ordered import global_rank
from swathe.sources.staging import release, stage

MESSAGES = {
    "left_target_set": "Planned, but no longer part of the target set when its batch ran.",
    "no_change": "Already has the requested values.",
    "entity_not_found": "Not found in this account when its batch ran.",
}


class ActionResult:
    """What an action did. The request is checked at once; every member is computed when it is
    first asked for.

    * ``table`` -- the whole new version of the table,
    * ``account_rows`` -- only the acting account's part of it, which is all that a write-back to
      an account-partitioned table has to replace,
    * ``outcomes`` -- one audit row per planned entity,
    * ``batches`` and ``stats`` -- counters per batch and for the action,
    * ``ledger`` -- newly claimed de-duplication keys (None without de-duplication).

    The per-row classes behind them are staged once (``classified``). An update or delete whose
    effect depends on each row alone does not need them: its ``table`` is a single projection.
    """

    def __init__(self, table: DataFrame, entity: EntitySpec, spec: ActionSpec, as_of: Any,
                 plan: DataFrame | None, ledger: DataFrame | None, stop_after: int | None,
                 failed: DataFrame | None, started_at: Any, finished_at: Any) -> None:
        self._source, self._entity, self._spec, self._as_of = table, entity, spec, as_of
        self._stop_after, self._failed = stop_after, failed
        self._times = (started_at, finished_at)
        params = check_spec(entity, spec, table.columns)
        self._action = get_action(spec.action, entity.name)
        self._mutation = self._action.build(entity, params, table)
        absent = sorted(set(self._mutation.assign) - set(table.columns))
        if absent:
            raise RequestError(f"The table has no column {absent}")
        self._size = batch_size_of(spec.batch_size, spec.rate_limit_per_minute)
        self._stored_plan = plan
        self._claimed = (None if ledger is None
                         else ledger.where(F.col("action_id") == spec.action_id))
        if spec.ids is None:
            self._predicate = target_predicate(table, entity, spec.account, spec.filter,
                                               self._action.include_deleted)
        else:
            self._predicate = in_scope(table, entity, spec.account, self._action.include_deleted)

    # --- target rows and their batches ------------------------------------------------------

    @cached_property
    def _rows(self) -> DataFrame:
        """Target rows with the few columns classification needs: key, duplicate field, whether
        they already look as requested."""
        pk, spec, mutation = self._entity.pk, self._spec, self._mutation
        columns = [F.col(pk)]
        if spec.dedup_by and spec.dedup_by != pk:
            columns.append(F.col(spec.dedup_by))
        unchanged = F.lit(False) if mutation.unchanged is None else mutation.unchanged
        columns.append(F.coalesce(unchanged, F.lit(False)).alias("_same"))
        if mutation.row_details:
            columns.append(mutation.details.alias("_details"))
        return self._source.where(self._predicate).select(*columns)

    @cached_property
    def _requested(self) -> DataFrame:
        """Explicit ids with their batches."""
        ids, pk = self._spec.ids, self._entity.pk
        if not isinstance(ids, DataFrame):
            kind = self._source.schema[pk].dataType.simpleString()
            ids = ids_frame(self._source.sparkSession, ids, pk, kind)
        return assign_ids(ids, pk, self._size)

    @cached_property
    def _batched_rows(self) -> DataFrame:
        return assign_batches(self._rows, self._entity.pk, self._size)

    @cached_property
    def _plan(self) -> DataFrame | None:
        """Planned batches, where they are more than a summary of the rows processed."""
        pk = self._entity.pk
        if self._spec.ids is not None:
            return summarise_batches(self._requested, pk)
        if self._stored_plan is not None:
            return self._stored_plan
        if self._failed is not None or self._stop_after is not None:
            return summarise_batches(self._batched_rows, pk)
        return None

    @cached_property
    def _plan_that_ran(self) -> DataFrame | None:
        ran = self._plan
        if ran is not None and self._failed is not None:
            ran = ran.join(self._failed.select("batch_index"), "batch_index", "left_anti")
        if ran is not None and self._stop_after is not None:
            ran = ran.where(F.col("batch_index") < self._stop_after)
        return ran

    # --- classification ---------------------------------------------------------------------

    @cached_property
    def classified(self) -> DataFrame:
        """Every live target row with its batch and class (applied / no_change / duplicate)."""
        pk, spec, by_ids = self._entity.pk, self._spec, self._spec.ids is not None
        if by_ids:
            live = self._rows.join(self._requested, pk)
        elif self._stored_plan is not None:
            live = resolve_batches(self._rows, pk, self._stored_plan)
        elif self._plan is not None:
            live = self._batched_rows
        else:
            live = self._rows
        if self._plan is not None:
            # Batches that gave up or were cancelled left no effect and claim no key.
            if self._failed is not None:
                live = live.join(self._failed.select("batch_index"), "batch_index", "left_anti")
            if self._stop_after is not None:
                live = live.where(F.col("batch_index") < self._stop_after)

        # A filter's batches follow the key order, so "first in batch order" is "first by key".
        order = ["batch_index", pk] if by_ids else [pk]
        if spec.dedup_by:
            live = mark_duplicates(live, pk, spec.dedup_by, order, self._claimed)
            duplicate = F.col("dedup_class") == DUPLICATE
        else:
            duplicate = F.lit(False)
        live = live.withColumn("action_class", F.when(duplicate, "duplicate")
                               .when(F.col("_same"), "no_change").otherwise("applied"))
        # Only what the audit rows need travels through the sort.
        columns = [pk, "action_class", *(["dedup_key"] if spec.dedup_by else []),
                   *(["_details"] if self._mutation.row_details else [])]
        if self._plan is None:
            # Numbering stages its input: one sort and one write for the whole action.
            return assign_batches(live.select(*columns), pk, self._size)
        return stage(live.select(*columns, "batch_index"), "classified")

    # --- results ----------------------------------------------------------------------------

    @cached_property
    def outcomes(self) -> DataFrame:
        pk, spec = self._entity.pk, self._spec
        kind = self._source.schema[pk].dataType
        rows = _audit_rows(self.classified, self._entity, spec, self._mutation)
        if self._plan_that_ran is not None and not (spec.ids is not None and spec.report_ids):
            gone = drift_rows(self._plan_that_ran, self.classified.select("batch_index"))
            rows = rows.unionByName(_simple_rows(
                gone.select("batch_index", F.lit(None).cast(kind).alias("entity_id")),
                spec, "skipped", "left_target_set"))
        elif self._plan_that_ran is not None:
            lost = (self._requested.join(self._plan_that_ran.select("batch_index"),
                                         "batch_index", "left_semi")
                    .join(self._rows.select(pk), pk, "left_anti")
                    .select("batch_index", F.col(pk).alias("entity_id")))
            rows = rows.unionByName(_simple_rows(lost, spec, "failed", "entity_not_found"))
        if self._failed is not None:
            gave_up = failed_batch_rows(self._plan, self._failed)
            rows = rows.unionByName(gave_up.select(
                F.lit(spec.action_id).alias("action_id"), "batch_index",
                F.lit(None).cast(kind).alias("entity_id"), "status", "reason_code", "message",
                F.lit(None).cast("string").alias("details")))
        return rows

    @cached_property
    def batches(self) -> DataFrame:
        if self._plan is None:
            return _whole_batches(self.outcomes, self._spec)
        return _batch_rows(self._plan.drop("status"), self.outcomes, self._spec,
                           self._stop_after, self._failed)

    @cached_property
    def stats(self) -> DataFrame:
        started, finished = self._times
        head = self._source.sparkSession.range(1).select(
            F.lit(self._spec.action_id).alias("action_id"),
            F.lit(self._entity.name).alias("entity_type"),
            F.lit(self._action.name).alias("action_type"),
            F.lit(started).cast("timestamp").alias("started_at"),
            F.lit(finished).cast("timestamp").alias("finished_at"))
        if self._stop_after is not None:
            stopped = self.batches.agg(F.count_if(F.col("status") == "cancelled")).scalar()
            head = head.withColumn("status", F.when(stopped > 0, "cancelled"))
        return single_action_stats(head, self.batches, self.outcomes)

    @property
    def _row_local(self) -> bool:
        """Whether a row's change depends on that row alone."""
        return not (self._spec.dedup_by or self._spec.ids is not None
                    or self._stored_plan is not None or self._failed is not None
                    or self._stop_after is not None)

    @cached_property
    def _chosen(self) -> Column:
        unchanged = self._mutation.unchanged
        if unchanged is None:
            return self._predicate
        return self._predicate & ~F.coalesce(unchanged, F.lit(False))

    @cached_property
    def _applied_keys(self) -> DataFrame:
        return self.classified.where(F.col("action_class") == "applied").select(self._entity.pk)

    @cached_property
    def table(self) -> DataFrame:
        if self._row_local:
            return mutate(self._source, self._entity, self._mutation, self._chosen, self._as_of)
        return mutate_keys(self._source, self._entity, self._mutation, self._applied_keys,
                           self._spec.account, self._as_of)

    @property
    def changed(self) -> Column | DataFrame:
        """The rows that change: a predicate over the table, or their keys."""
        return self._chosen if self._row_local else self._applied_keys

    def rewrite(self, rows: DataFrame) -> DataFrame:
        """Any part of the table as it is afterwards."""
        if self._row_local:
            return mutate(rows, self._entity, self._mutation, self._chosen, self._as_of)
        return account_slice(rows, self._entity, self._mutation, self._applied_keys, self._as_of)

    @cached_property
    def account_rows(self) -> DataFrame:
        ours = self._source.where(
            F.col(self._entity.account) == F.lit(self._spec.account))
        if self._row_local:
            return mutate(ours, self._entity, self._mutation, self._chosen, self._as_of)
        return account_slice(ours, self._entity, self._mutation, self._applied_keys, self._as_of)

    @cached_property
    def ledger(self) -> DataFrame | None:
        if not self._spec.dedup_by:
            return None
        owners = self.classified.withColumn("dedup_class", F.when(
            (F.col("action_class") != "duplicate") & F.col("dedup_key").isNotNull(), UNIQUE))
        return claimed_keys(owners, self._entity.pk, self._spec.action_id, self._claimed)

    def release(self) -> None:
        """Remove the staged files once all results have been written."""
        release(*(self.__dict__[n] for n in ("classified", "_requested", "_batched_rows")
                  if n in self.__dict__))


def run_action(
    table: DataFrame,
    entity: EntitySpec,
    spec: ActionSpec,
    as_of: Any,
    *,
    plan: DataFrame | None = None,
    ledger: DataFrame | None = None,
    stop_after: int | None = None,
    failed: DataFrame | None = None,
    started_at: Any = None,
    finished_at: Any = None,
) -> ActionResult:
    """Apply ``spec`` to ``table``.

    ``plan`` is a stored batch plan (:func:`plan_batches`) made on an earlier state of the table;
    planned entities that left the target set since then are audited as such. Without it, batches
    are formed from the table as it is. ``ledger(action_id, dedup_key, winner_pk)`` makes a
    repeated run keep its winners. ``stop_after`` cancels the batches from that index on;
    ``failed(batch_index, error)`` lists batches that gave up and left no effect.
    """
    return ActionResult(table, entity, spec, as_of, plan, ledger, stop_after, failed, started_at,
                        finished_at)


def _audit_rows(classified: DataFrame, entity: EntitySpec, spec: ActionSpec, mutation: Mutation
                ) -> DataFrame:
    kind = F.col("action_class")
    none = F.lit(None).cast("string")
    field = spec.dedup_by or "key"
    if mutation.row_details:
        effect = F.col("_details")
    else:
        effect = none if mutation.details is None else mutation.details
    details = F.when(kind == "applied", effect)
    message = F.when(kind == "no_change", MESSAGES["no_change"])
    if spec.dedup_by:
        duplicate = F.to_json(F.struct(F.col("dedup_key").alias(field)))
        details = details.when(kind == "duplicate", duplicate)
        message = message.when(
            kind == "duplicate", f"Another row with the same {field} was processed first.")
    return classified.select(
        F.lit(spec.action_id).alias("action_id"), "batch_index",
        F.col(entity.pk).alias("entity_id"),
        F.when(kind == "applied", "success").otherwise("skipped").alias("status"),
        F.when(kind == "applied", mutation.reason).when(kind == "no_change", "no_change")
        .otherwise(duplicate_reason(field)).alias("reason_code"),
        message.alias("message"), details.alias("details"))


def _simple_rows(rows: DataFrame, spec: ActionSpec, status: str, reason: str) -> DataFrame:
    return rows.select(
        F.lit(spec.action_id).alias("action_id"), "batch_index", "entity_id",
        F.lit(status).alias("status"), F.lit(reason).alias("reason_code"),
        F.lit(MESSAGES[reason]).alias("message"), F.lit(None).cast("string").alias("details"))


def _whole_batches(outcomes: DataFrame, spec: ActionSpec) -> DataFrame:
    """Batches of an action whose batches were formed from the very rows it processed: key range,
    size and counters in one aggregation."""
    return outcomes.groupBy("batch_index").agg(
        F.min("entity_id").alias("cursor_start"), F.max("entity_id").alias("cursor_end"),
        F.count("*").alias("entity_count"), *outcome_counts(),
    ).select(F.lit(spec.action_id).alias("action_id"), "batch_index", "cursor_start",
             "cursor_end", "entity_count", F.lit("completed").alias("status"),
             "success_count", "failure_count", "skipped_count", "processed_count",
             F.lit(None).cast("string").alias("error"))


def _batch_rows(summary: DataFrame, outcomes: DataFrame, spec: ActionSpec,
                stop_after: int | None, failed: DataFrame | None) -> DataFrame:
    counts = batch_counts(outcomes)
    zero = F.lit(0).cast("bigint")
    status = F.lit("completed")
    joined = summary.join(counts, "batch_index", "left")
    if failed is not None:
        joined = joined.join(failed, "batch_index", "left")
        status = F.when(F.col("error").isNotNull(), "failed").otherwise(status)
    else:
        joined = joined.withColumn("error", F.lit(None).cast("string"))
    if stop_after is not None:
        status = F.when(F.col("batch_index") >= stop_after, "cancelled").otherwise(status)
    return joined.select(
        F.lit(spec.action_id).alias("action_id"), "batch_index", "cursor_start", "cursor_end",
        "entity_count", status.alias("status"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in
          ("success_count", "failure_count", "skipped_count", "processed_count")], "error")


def numbered_outcomes(outcomes: DataFrame) -> DataFrame:
    """Add ``log_id``, the row's place in (action, batch, entity, reason) order, for keyset paging.

    Batches may grow without bound after planning, so the number is a global rank and not packed
    from batch and place.
    """
    return global_rank(outcomes, ["action_id", "batch_index", "entity_id", "reason_code"],
                       "log_id")


__all__ = ["MESSAGES", "ActionResult", "numbered_outcomes", "run_action"]
