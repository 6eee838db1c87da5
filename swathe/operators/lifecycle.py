"""Histories of status changes: final statuses and refused steps, however long a history is.

A step that the life cycle does not allow leaves the status as it was, so a step is a function from
statuses to statuses, and a history is the composition of its steps. Compositions of runs of steps
are made in parallel, then those of runs of runs, up to one per history; back down, every run learns
the status it starts from, and so does every step. No group holds more than ``FAN`` elements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.model import ACTION_STATUSES, STARTABLE_STATUSES, TERMINAL_STATUSES
from swathe.operators.ordered import rank_within
from swathe.sources.staging import release, stage

FAN = 1024
_BITS = 3  # of a status number; a function of eight statuses is a number of 24 bits
_IDENTITY = sum(i << _BITS * i for i in range(len(ACTION_STATUSES)))


def may_follow(before: str, after: str) -> bool:
    """Whether an action of status ``before`` may become ``after``."""
    if before in TERMINAL_STATUSES:
        return False
    if after in ("planning", "processing"):
        return before in STARTABLE_STATUSES
    if after in ("completed", "completed_with_errors"):
        return before in ("planning", "processing")
    return after in ("failed", "cancelled")


def step_function(after: str) -> int:
    """The step to ``after`` as a number: the status that each status becomes, three bits each."""
    to = ACTION_STATUSES.index(after)
    return sum((to if may_follow(s, after) else i) << _BITS * i
               for i, s in enumerate(ACTION_STATUSES))


def _apply(function: Column, status: Column) -> Column:
    """Status number after a function."""
    moved = F.call_function("shiftright", function, status * _BITS)
    return moved.bitwiseAND(F.lit((1 << _BITS) - 1))


def _then(first: Column, second: Column) -> Column:
    """The function that does ``first`` and then ``second``."""
    out = F.lit(0)
    for i in range(len(ACTION_STATUSES)):
        moved = _apply(second, _apply(first, F.lit(i)))
        out = out.bitwiseOR(F.shiftleft(moved, _BITS * i))
    return out


def fold_statuses(events: DataFrame, key: str, order_by: Sequence[str], status: str = "status",
                  start: str = "queued") -> DataFrame:
    """``events`` with the status ``before`` each step, the status ``after`` it and whether it was
    ``allowed``; histories begin with ``start``.

    ``(key, *order_by)`` is unique. A status that does not exist is never allowed; null keys are
    one history.
    """
    names = F.array(*map(F.lit, ACTION_STATUSES))
    table = F.create_map(*[c for s in ACTION_STATUSES for c in (F.lit(s), F.lit(step_function(s)))])
    ranked = rank_within(events.withColumn("_f", F.coalesce(
        F.element_at(table, F.col(status)), F.lit(_IDENTITY))), [key], order_by, "_rank")
    level = stage(ranked.withColumn("_n", F.col("_rank") - 1).drop("_rank"), "steps")
    levels = [level]
    while True:
        runs = levels[-1].groupBy(F.col(key), F.expr(f"_n div {FAN}").alias("_up")).agg(
            F.sort_array(F.collect_list(F.struct("_n", "_f"))).alias("_run"))
        runs = stage(runs.select(key, F.col("_up").alias("_n"), F.aggregate(
            "_run", F.lit(_IDENTITY), lambda f, s: _then(f, s["_f"])).alias("_f")), "runs")
        levels.append(runs)
        if runs.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0] == 0:
            break
    first = ACTION_STATUSES.index(start)
    starts = levels[-1].select(F.col(key), "_n", F.lit(first).alias("_at"))
    for below in reversed(levels[:-1]):
        starts = stage(_spread(below, starts, key), "starts")
    # Staged columns are small as files but not as rows: sorted sides spill, a broadcast would not.
    steps = level.join(starts.hint("merge"), level[key].eqNullSafe(starts[key]) & (level["_n"] == starts["_n"])
                       ).select(*[level[c] for c in events.columns], "_at", "_f")
    release(*levels[1:])
    masks = F.create_map(*[c for s in ACTION_STATUSES for c in (F.lit(s), F.lit(
        sum(1 << i for i, before in enumerate(ACTION_STATUSES) if may_follow(before, s))))])
    mask = F.coalesce(F.element_at(masks, F.col(status)), F.lit(0))
    return steps.select(
        *events.columns, F.get(names, F.col("_at")).alias("before"),
        F.get(names, _apply(F.col("_f"), F.col("_at"))).alias("after"),
        (F.call_function("shiftright", mask, F.col("_at")).bitwiseAND(F.lit(1)) == 1).alias("allowed"))


def _spread(below: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Start of every element from the start of its run."""
    runs = below.groupBy(F.col(key), F.expr(f"_n div {FAN}").alias("_up")).agg(
        F.sort_array(F.collect_list(F.struct("_n", "_f"))).alias("_run"))
    above = starts.select(F.col(key).alias("_key"), F.col("_n").alias("_of"), "_at")
    joined = runs.join(above.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_up") == F.col("_of")))
    begin = F.struct(F.col("_at").alias("at"),
                     F.array().cast("array<struct<n:long,at:int>>").alias("out"))
    each = F.aggregate("_run", begin, lambda state, s: F.struct(
        _apply(s["_f"], state["at"]).alias("at"),
        F.concat(state["out"], F.array(F.struct(s["_n"].alias("n"), state["at"].alias("at")))
                 ).alias("out")), lambda state: state["out"])
    return joined.select(F.col(key), F.inline(each).alias("_n", "_at"))


def final_statuses(folded: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Last status per history, its steps and how many were refused."""
    return folded.groupBy(key).agg(
        F.max_by("after", F.struct(*order_by)).alias("status"), F.count("*").alias("steps"),
        F.count_if(~F.col("allowed")).alias("refused"))
