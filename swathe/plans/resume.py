"""A bulk action that runs in several goes: some batches now, the others later.

The plan is stored once. Each go takes the batches that are not finished and that the account's rate
limit admits, in batch order; reads only the key ranges of these; and commits their rows, audit rows,
counters and claimed keys together with the table's next version. A go that dies leaves no trace, one
that is delivered again finds its batches finished, and the sums over all goes are those of one run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.model import ActionSpec, ConflictError, EntitySpec
from swathe.operators.accounting import action_counters, action_stats, reason_breakdown
from swathe.operators.batching import plan_batches
from swathe.operators.ratelimit import bucket_levels, deferrals, token_bucket
from swathe.operators.targets import select_targets
from swathe.functions.measures import batch_size_of
from swathe.plans.bulk import run_action
from swathe.sources.staging import stage
from swathe.sources.store import Store

FINISHED = ("completed", "failed", "cancelled")
RANGES = 200  # key ranges that one scan is asked for; more are joined by closing small gaps


@dataclass(frozen=True)
class Go:
    """What one call did: the version it made (None if there was nothing to do) and the batches
    that the rate limit put off, with the time of their next try."""

    version: int | None
    deferred: DataFrame | None


def submit(store: Store, entity: EntitySpec, spec: ActionSpec, at: Any) -> bool:
    """Store the plan of an action with a filter; False if it is there already."""
    while True:
        base = store.version()
        if store.rows("plan", base, action=spec.action_id) is not None:
            return False
        size = batch_size_of(spec.batch_size, spec.rate_limit_per_minute)
        targets = select_targets(store.table(base), entity, spec.account, spec.filter)
        plan = plan_batches(targets, entity.pk, size).withColumn(
            "created_at", F.lit(at).cast("timestamp"))
        if store.add_rows({"plan": plan}, {"action": spec.action_id}, base) is not None:
            return True


def batches(store: Store, action_id: str, version: int | None = None) -> DataFrame:
    """All batches of an action with their state: what was committed last, else ``pending``."""
    plan = store.rows("plan", version, action=action_id)
    if plan is None:
        raise FileNotFoundError(f"action {action_id!r} has no plan")
    done = store.rows("batches", version, action=action_id)
    zero = F.lit(0).cast("bigint")
    counters = ("success_count", "failure_count", "skipped_count", "processed_count")
    if done is None:
        return plan.drop("created_at").withColumns(
            {**{c: zero for c in counters}, "finished_at": F.lit(None).cast("timestamp")})
    done = done.select("batch_index", F.col("status").alias("_status"), *counters, "finished_at")
    return plan.drop("created_at").join(done, "batch_index", "left").select(
        "batch_index", "cursor_start", "cursor_end", "entity_count",
        F.coalesce("_status", "status").alias("status"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in counters], "finished_at")


def _admitted(store: Store, open_batches: DataFrame, spec: ActionSpec, at: Any, base: int
              ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batches that the account's bucket admits at ``at``, those it puts off, and its new level.

    The bucket is the account's, so it goes on from the level that the last go of any of the
    account's actions left."""
    requests = open_batches.select(
        "batch_index", "entity_count", F.lit(str(spec.account)).alias("account_id"),
        F.lit(at).cast("timestamp").alias("at"),
        F.lit(spec.rate_limit_per_minute).alias("rate_limit_per_minute"))
    held = store.rows("levels", base, account=str(spec.account))
    levels = None if held is None else held.groupBy("account_id").agg(
        F.max_by(F.struct("level", "level_ms"), "version").alias("_l")).select("account_id", "_l.*")
    decided = stage(token_bucket(requests, "account_id", ["batch_index"], "at", "entity_count",
                                 "rate_limit_per_minute", levels=levels), "admission")
    # In batch order: a batch behind one that waits waits too, so keys go to the first rows.
    stopped = decided.where(~F.col("allowed") & ~F.col("unsatisfiable")).agg(
        F.min("batch_index")).scalar()
    ahead = F.coalesce(F.col("batch_index") < stopped, F.lit(True))
    admitted = decided.where(F.col("allowed") & ahead)
    after = bucket_levels(admitted, "account_id", ["batch_index"], "at", "entity_count")
    return (open_batches.join(admitted.select("batch_index"), "batch_index", "left_semi"),
            deferrals(decided, "at"), after)


def _key_ranges(chosen: DataFrame, pk: str) -> Column:
    """Where the batches' keys lie, as a predicate that reaches the scan: runs of neighbouring
    batches as ranges, the widest gaps left out."""
    order = Window.orderBy("batch_index")  # one row per batch of one action
    marked = chosen.withColumn("_new", F.coalesce(
        F.col("batch_index") - F.lag("batch_index").over(order) > 1, F.lit(True)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(order)).groupBy("_run").agg(
        F.min("cursor_start").alias("a"), F.max("cursor_end").alias("b"),
        F.min("batch_index").alias("first"), F.max("batch_index").alias("last"))
    gap = F.col("first") - F.lag("last").over(Window.orderBy("first"))
    wide = runs.withColumn("_gap", F.coalesce(gap, F.lit(1 << 62))).withColumn(
        "_cut", F.row_number().over(Window.orderBy(F.desc("_gap"), "first")) <= RANGES)
    joined = wide.withColumn("_range", F.sum(F.col("_cut").cast("int")).over(
        Window.orderBy("first"))).groupBy("_range").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    ranges = joined.collect()  # at most RANGES rows
    return reduce(lambda x, y: x | y, (F.col(pk).between(F.lit(r["a"]), F.lit(r["b"]))
                                       for r in ranges), F.lit(False))


def advance(store: Store, entity: EntitySpec, spec: ActionSpec, at: Any, *,
            limit: int | None = None, failed: DataFrame | None = None, tries: int = 20) -> Go:
    """Run the batches of a submitted action that are open and admitted at ``at`` (the first
    ``limit`` of them), and commit what they did. ``failed(batch_index, error)`` names batches
    that give up in this go."""
    for _ in range(tries):
        base = store.version()
        open_batches = stage(batches(store, spec.action_id, base).where(
            ~F.col("status").isin(*FINISHED)).select(
                "batch_index", "cursor_start", "cursor_end", "entity_count", "status"), "open")
        chosen, deferred, levels = _admitted(store, open_batches, spec, at, base)
        if limit is not None:
            chosen = chosen.orderBy("batch_index").limit(limit)
        chosen = stage(chosen, "chosen")
        if chosen.isEmpty():
            return Go(None, deferred)
        ranges = _key_ranges(chosen, entity.pk)
        held = store.rows("ledger", base, action=spec.action_id)
        go = run_action(store.table(base).where(ranges), entity, spec, at, plan=chosen,
                        ledger=held, failed=None if failed is None else failed.join(
                            chosen.select("batch_index"), "batch_index", "left_semi"))
        parts = {
            "outcomes": go.outcomes,
            "batches": go.batches.withColumn("finished_at", F.lit(at).cast("timestamp")),
            "levels": levels.withColumn("version", F.lit(base + 1))}
        if go.ledger is not None:
            parts["ledger"] = go.ledger
        number = store.change(go.changed, go.rewrite, parts, {
            "action": spec.action_id, "account": str(spec.account)}, base)
        go.release()
        if number is not None:
            return Go(number, deferred)
    raise ConflictError(f"{tries} other commits came first")


def cancel(store: Store, action_id: str, at: Any) -> int | None:
    """Give up the batches that have not run: they are committed as cancelled."""
    while True:
        base = store.version()
        left = batches(store, action_id, base).where(~F.col("status").isin(*FINISHED))
        if left.isEmpty():
            return None
        rows = left.withColumns({
            "status": F.lit("cancelled"), "finished_at": F.lit(at).cast("timestamp"),
            "action_id": F.lit(action_id), "error": F.lit(None).cast("string")})
        number = store.add_rows({"batches": rows}, {"action": action_id}, base)
        if number is not None:
            return number


def statistics(store: Store, entity: EntitySpec, spec: ActionSpec, version: int | None = None
               ) -> DataFrame:
    """The action's statistics record so far."""
    found = batches(store, spec.action_id, version)
    outcomes = store.rows("outcomes", version, action=spec.action_id)
    plan = store.rows("plan", version, action=spec.action_id)
    every = found.withColumn("action_id", F.lit(spec.action_id))
    state = found.agg(
        F.count_if(F.col("status") == "cancelled").alias("_cancelled"),
        F.count_if(~F.col("status").isin(*FINISHED)).alias("_open"),
        F.max("finished_at").alias("_last"))
    head = plan.agg(F.min("created_at").alias("started_at")).select(
        F.lit(spec.action_id).alias("action_id"), F.lit(entity.name).alias("entity_type"),
        F.lit(spec.action).alias("action_type"), "started_at",
        F.when(state.select("_open").scalar() == 0, state.select("_last").scalar()).alias(
            "finished_at"),
        F.when(state.select("_cancelled").scalar() > 0, "cancelled").alias("status"))
    if outcomes is None:
        outcomes = every.where("false").select(
            "action_id", "status", F.lit(None).cast("string").alias("reason_code"))
    return action_stats(head, action_counters(every), reason_breakdown(outcomes))


__all__ = ["Go", "advance", "batches", "cancel", "statistics", "submit"]
