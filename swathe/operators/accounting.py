"""Counters, statistics and life cycle of actions and batches, derived from their rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.functions.measures import (
    duration_seconds,
    pending,
    per_minute,
    progress_percent,
)
from swathe.functions.text import truncate
from swathe.model import (
    ACTION_ERROR_LENGTH,
    MAX_BATCH_ATTEMPTS,
    OUTCOME_MESSAGE_LENGTH,
    STARTABLE_STATUSES,
    TERMINAL_STATUSES,
)
from swathe.operators.ordered import median_within, previous_row, running_sum

_COUNTS = ("success_count", "failure_count", "skipped_count", "processed_count")


def outcome_counts() -> list[Column]:
    """Success / failure / skipped / processed counters over audit rows."""
    return [
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
        F.count_if(F.col("status") == "skipped").alias("skipped_count"),
        F.count("*").alias("processed_count"),
    ]


def batch_counts(outcomes: DataFrame, keys: Sequence[str] = ("batch_index",)) -> DataFrame:
    """Counters per batch."""
    return outcomes.groupBy(*keys).agg(*outcome_counts())


def action_counters(batches: DataFrame, keys: Sequence[str] = ("action_id",)) -> DataFrame:
    """Counters per action: the sums over its batches and how many of them finished."""
    return batches.groupBy(*keys).agg(
        F.coalesce(F.sum("entity_count"), F.lit(0)).alias("total_entities"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS],
        F.count("*").alias("total_batches"),
        F.count_if(F.col("status").isin("completed", "failed")).alias("completed_batches"),
    )


def actions_total(counters: DataFrame) -> DataFrame:
    """Counters over several actions."""
    return counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                          for c in _COUNTS])


def reason_breakdown(outcomes: DataFrame, keys: Sequence[str] = ("action_id",)) -> DataFrame:
    """Failed and skipped rows per reason."""
    return (outcomes.where(F.col("status").isin("failed", "skipped"))
            .groupBy(*keys, "status",
                     F.coalesce("reason_code", F.lit("unspecified")).alias("reason_code"))
            .agg(F.count("*").alias("n")))


def breakdown_maps(breakdown: DataFrame, keys: Sequence[str] = ("action_id",)) -> DataFrame:
    """The breakdown as two maps per action (one entry per reason code, so small)."""
    def entries(status: str) -> Column:
        pair = F.when(F.col("status") == status, F.struct("reason_code", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(pair)))
    return breakdown.groupBy(*keys).agg(entries("failed").alias("failure_breakdown"),
                                        entries("skipped").alias("skip_breakdown"))


def final_status(cancelled: Column | None = None) -> Column:
    """Status of an action from its counter columns; an empty target set completes at once."""
    done = F.col("completed_batches") >= F.col("total_batches")
    status = (F.when(~done, "processing")
              .when(F.col("failure_count") > 0, "completed_with_errors")
              .otherwise("completed"))
    return status if cancelled is None else F.when(cancelled, "cancelled").otherwise(status)


def action_stats(actions: DataFrame, counters: DataFrame, breakdown: DataFrame,
                 now: Any = None) -> DataFrame:
    """Statistics record per action.

    ``actions`` has ``action_id, entity_type, action_type, started_at, finished_at`` and an
    optional ``status`` (given for cancelled actions, derived from the counters otherwise).
    """
    joined = (actions.join(counters, "action_id", "left")
              .join(breakdown_maps(breakdown), "action_id", "left"))
    return _stats_record(joined, "status" in actions.columns, now)


def single_action_stats(head: DataFrame, batches: DataFrame, outcomes: DataFrame,
                        now: Any = None) -> DataFrame:
    """:func:`action_stats` when all rows belong to the one action in ``head`` (one row)."""
    counters = action_counters(batches, [])
    maps = breakdown_maps(reason_breakdown(outcomes, []), [])
    joined = head.select(
        "*",
        counters.select(F.struct(*counters.columns).alias("c")).scalar().alias("_c"),
        maps.select(F.struct(*maps.columns).alias("m")).scalar().alias("_m"),
    ).select(*head.columns, "_c.*", "_m.*")
    return _stats_record(joined, "status" in head.columns, now)


def _stats_record(joined: DataFrame, has_status: bool, now: Any) -> DataFrame:
    empty = F.from_json(F.lit("{}"), "map<string,bigint>")
    zero = F.lit(0).cast("bigint")
    counted = ["total_entities", *_COUNTS, "total_batches", "completed_batches"]
    joined = joined.withColumns({c: F.coalesce(F.col(c), zero) for c in counted})
    derived = final_status()
    joined = joined.withColumn("status", F.coalesce("status", derived) if has_status else derived)
    finished = F.col("status").isin("completed", "completed_with_errors")
    seconds = duration_seconds("started_at", "finished_at", None if now is None else F.lit(now))
    return joined.select(
        "action_id", "status", "entity_type", "action_type", "total_entities",
        "processed_count", "success_count", "failure_count", "skipped_count",
        pending("total_entities", "processed_count").alias("pending_count"),
        "total_batches", "completed_batches",
        progress_percent("processed_count", "total_entities", finished).alias("progress_percent"),
        "started_at", "finished_at",
        F.round(seconds, 3).alias("duration_seconds"),
        per_minute("processed_count", seconds).alias("entities_per_minute"),
        F.coalesce("failure_breakdown", empty).alias("failure_breakdown"),
        F.coalesce("skip_breakdown", empty).alias("skip_breakdown"),
    )


def conservation(counters: DataFrame) -> DataFrame:
    """Does every processed entity have exactly one outcome?"""
    parts = F.col("success_count") + F.col("failure_count") + F.col("skipped_count")
    return counters.withColumn("conserved", (parts == F.col("processed_count"))
                               & (F.col("processed_count") == F.col("total_entities")))


def batch_state_counts(batches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return batches.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def progress_timeline(batches: DataFrame, totals: DataFrame) -> DataFrame:
    """Cumulative counters after each finished batch, in order of finishing.

    ``batches`` needs ``action_id, batch_index, finished_at`` and the counters; ``totals`` has one
    row per action with ``total_entities`` and ``total_batches``. An action may own most of the
    batches: the running sums are not confined to one task per action.
    """
    done = batches.where(F.col("finished_at").isNotNull())
    run = running_sum(done, ["action_id"], ["finished_at", "batch_index"], {
        **{f"run_{c}": c for c in _COUNTS}, "completed_batches": F.lit(1).cast("bigint")})
    joined = run.join(totals.select("action_id", "total_entities", "total_batches"), "action_id")
    finishing = F.col("completed_batches") == F.col("total_batches")
    return joined.select(
        "action_id", "batch_index", "finished_at",
        *[F.col(f"run_{c}").alias(c) for c in _COUNTS],
        "completed_batches", "total_batches", "total_entities",
        progress_percent("run_processed_count", "total_entities", finishing)
        .alias("progress_percent"),
        finishing.alias("is_last"))


def finishing_batches(timeline: DataFrame) -> DataFrame:
    """The batch whose completion closes its action."""
    return timeline.where("is_last").select("action_id", "batch_index", "finished_at")


def apply_cancellation(batches: DataFrame, cancelled_at: Column) -> DataFrame:
    """Cancel at batch boundaries: what finished by then stays, everything else is cancelled."""
    keeps = F.coalesce(F.col("finished_at") <= cancelled_at, F.lit(False)) | cancelled_at.isNull()
    counters = [c for c in _COUNTS if c in batches.columns]
    return batches.withColumns({
        "status": F.when(keeps, F.col("status")).otherwise("cancelled"),
        "finished_at": F.when(keeps, F.col("finished_at")).otherwise(cancelled_at),
        **{c: F.when(keeps, F.col(c)).otherwise(F.lit(0)) for c in counters},
    })


def cancellable(status: Column | str = "status") -> Column:
    """False for actions in a terminal status: cancelling those is a conflict."""
    c = F.col(status) if isinstance(status, str) else status
    return ~c.isin(*TERMINAL_STATUSES)


def failed_batch_rows(batches: DataFrame, errors: DataFrame,
                      keys: Sequence[str] = ("batch_index",)) -> DataFrame:
    """Audit rows of batches that gave up: one failed row per planned entity, without entity ids
    since the batch never loaded them. ``errors`` has the ``keys`` and an ``error`` text."""
    message = F.concat(F.lit(f"Gave up after {MAX_BATCH_ATTEMPTS} attempts: "), F.col("error"))
    # Cut where the texts are read: they may be long, and are met once per batch, not per entity.
    messages = errors.select(*keys, truncate(message, OUTCOME_MESSAGE_LENGTH).alias("message"))
    rows = batches.select(*keys, "entity_count").where(F.col("entity_count") > 0).join(
        messages, list(keys))
    return rows.select(
        *keys,
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("entity_count"))).alias("entity_no"),
        F.lit("failed").alias("status"), F.lit("batch_error").alias("reason_code"), "message")


def can_start(status: Column | str = "status") -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return c.isin(*STARTABLE_STATUSES)


def transition_allowed(before: Column | str, after: Column | str) -> Column:
    """Life-cycle guard of an action's status changes."""
    a = F.col(before) if isinstance(before, str) else before
    b = F.col(after) if isinstance(after, str) else after
    return (
        F.when(a.isin(*TERMINAL_STATUSES), False)
        .when(b == "processing", can_start(a))
        .when(b == "planning", can_start(a))
        .when(b.isin("completed", "completed_with_errors"), a.isin("planning", "processing"))
        .when(b.isin("failed", "cancelled"), True)
        .otherwise(False))


def fail_actions(actions: DataFrame, failures: DataFrame, as_of: Any) -> DataFrame:
    """Close actions that could not run: ``failures(action_id, failure)``. Finished ones keep
    their status."""
    joined = actions.join(failures, "action_id", "left")
    hit = F.col("failure").isNotNull() & ~F.col("status").isin(*TERMINAL_STATUSES)
    return joined.select(*[
        F.when(hit, {"status": F.lit("failed"),
                     "error": truncate("failure", ACTION_ERROR_LENGTH),
                     "finished_at": F.lit(as_of)}[c]).otherwise(F.col(c)).alias(c)
        if c in ("status", "error", "finished_at") else F.col(c) for c in actions.columns])


def attempts(attempt_log: DataFrame, keys: Sequence[str] = ("action_id", "batch_index")
             ) -> DataFrame:
    """Attempts per batch from the log of started attempts."""
    return attempt_log.groupBy(*keys).agg(F.count("*").alias("attempts"))


def steady_state_rate(samples: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Median growth of ``value`` per minute between consecutive samples, without the first and
    the last sample (start-up and a partial end). Null below four samples.

    ``time`` is seconds and unique per key.
    """
    bounds = samples.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"),
                                        F.count("*").alias("_n"))
    inner = (samples.join(bounds, [*keys])
             .where((F.col("_n") >= 4) & (F.col(time) > F.col("_lo"))
                    & (F.col(time) < F.col("_hi")))
             .select(*keys, time, value))
    pairs = previous_row(inner, keys, [time], {"_t0": time, "_v0": value})
    step = F.col(time) - F.col("_t0")
    rates = pairs.where(step > 0).select(
        *keys, time, ((F.col(value) - F.col("_v0")) / step * 60).alias("_rate"))
    median = median_within(rates, keys, "_rate", [time], "per_minute")
    return bounds.select(*keys, F.col("_n").alias("samples")).join(median, [*keys], "left")
