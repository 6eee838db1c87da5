"""Token buckets per account over a table of requests.

A bucket holds at most ``limit`` tokens, refills ``limit`` per period, starts full, and admits a
request when it holds enough tokens. Amounts are counted in integer units of ``1/period_ms`` token,
so refilling for some milliseconds is integer arithmetic and every decision is exact.

Decisions are sequential within an account, and one account may own a large share of all requests.
Requests are therefore laid out in (account, time) order and cut into bounded runs. An account
that spans several runs is solved in steps, all runs in parallel in each:

1. Between which levels can a run end, whatever level it began with? Two numbers per run, moved from
   request to request (:func:`_reach`). A busy bucket soon holds less than one request needs, an idle
   one is full, so the bounds close in on each other. They bound where the next run begins.
2. What does a run make of the levels that it may begin with? A piecewise function, with few pieces
   because the range is narrow (:func:`_run_effect`).
3. The functions of an account are chained, which gives every run its starting level, and all runs
   decide.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from swathe.functions.measures import retry_after_ms
from swathe.model import DEFAULT_SUBMISSIONS_PER_MINUTE, IDLE_STATE_GRACE_MS
from swathe.operators.ordered import PART, POS, ordered_layout, running_sum

MINUTE_MS = 60_000


def _decide(at: np.ndarray, amount: np.ndarray, limit: np.ndarray, period: int,
            level: int | None, last: int | None = None):
    """Run one bucket over its requests in order. Returns admitted flags and the level (in units)
    after each request. ``level`` None means that the bucket is new and therefore full; it is as of
    time ``last``, or as of the first request when ``last`` is None."""
    admitted = np.empty(len(at), dtype=bool)
    levels = np.empty(len(at), dtype=np.int64)
    for i, (now, need, cap) in enumerate(zip(at.tolist(), amount.tolist(), limit.tolist())):
        full = cap * period
        if level is None:
            level = full
        elapsed = 0 if last is None else min(max(now - last, 0), period)
        level = min(full, level + elapsed * cap)
        last = now if last is None else max(last, now)  # time never runs backwards
        need *= period
        admitted[i] = level >= need
        if admitted[i]:
            level -= need
        levels[i] = level
    return admitted, levels


def _reach(at: np.ndarray, amount: np.ndarray, limit: np.ndarray, period: int, low: int,
           high: int, last: int | None = None) -> tuple[int, int]:
    """Bounds of the level after a run that begins (at ``last``, or its first request) with a level
    from ``low`` to ``high``."""
    for now, need, cap in zip(at.tolist(), amount.tolist(), limit.tolist()):
        full, need = cap * period, need * period
        if last is not None:
            refill = min(max(now - last, 0), period) * cap
            low, high = min(full, low + refill), min(full, high + refill)
        last = now
        if low >= need:
            low, high = low - need, high - need
        elif high >= need:  # some levels pay, down to 0, and those below the need stay
            low, high = 0, max(need - 1, high - need)
    return low, high


def _run_effect(at: np.ndarray, amount: np.ndarray, limit: np.ndarray, period: int,
                pieces: tuple | None = None, last: int | None = None,
                domain: tuple[int, int] | None = None):
    """Level after a run as a function of the level at its first request, which lies in ``domain``
    (any level by default).

    The function is piecewise: on ``[start[i], start[i+1])`` it is either the constant
    ``value[i]`` or the start level plus ``value[i]`` (``moves[i]``). Every request refills (levels
    reaching the top become one constant) and then takes its amount from the levels that have it.
    Neighbouring pieces with the same effect are merged, so requests of one size need at most about
    (width of the domain) / size pieces. ``pieces`` continues an effect whose last request was at ``last``.
    """
    if pieces is None:
        # First start level of each piece (the last entry ends the domain), then its constant
        # result or shift.
        low, high = (0, int(limit[0]) * period) if domain is None else domain
        start = np.array([low, high + 1], dtype=np.int64)
        value, moves = np.array([0], dtype=np.int64), np.array([True])
    else:
        start, value, moves = pieces
    start, stop = start[:-1], start[-1]
    for i, (now, need, cap) in enumerate(zip(at.tolist(), amount.tolist(), limit.tolist())):
        if len(value) == 1 and not moves[0]:
            # Every start level has led to the same level (the bucket was full once): from here
            # on it is one ordinary bucket.
            _, levels = _decide(at[i:], amount[i:], limit[i:], period, int(value[0]), last)
            return np.array([start[0], stop]), levels[-1:], moves
        full, need = cap * period, need * period
        refill = 0 if last is None else min(max(now - last, 0), period) * cap
        last = now
        value = value + refill
        for bound, capped in ((full, True), (need, False)):
            # Cut moving pieces where their level crosses the bound, then act on the upper side.
            end = np.append(start[1:], stop)
            crossing = bound - value
            cut = moves & (crossing > start) & (crossing < end)
            if cut.any():
                start = np.concatenate([start, crossing[cut]])
                value = np.concatenate([value, value[cut]])
                moves = np.concatenate([moves, moves[cut]])
                order = np.argsort(start, kind="stable")
                start, value, moves = start[order], value[order], moves[order]
            above = np.where(moves, start + value, value) >= bound
            if capped:
                value = np.where(above, full, value)
                moves = moves & ~above
            else:
                value = np.where(above, value - need, value)
        keep = np.append(True, (np.diff(value) != 0) | (moves[1:] != moves[:-1]))
        start, value, moves = start[keep], value[keep], moves[keep]
    return np.append(start, stop), value, moves


def token_bucket(
    requests: DataFrame,
    account: str,
    order_by: Sequence[str],
    at: str,
    amount: str,
    limit: str,
    period_ms: int = MINUTE_MS,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Decide every request: adds ``allowed``, ``retry_after_seconds``, ``tokens_remaining`` and
    ``unsatisfiable``.

    ``order_by`` fixes the request order within an account (``at``, then an id). Requests for
    nothing are always admitted and requests above the limit never; neither touches the bucket.
    ``levels`` continues buckets of earlier requests (see :func:`bucket_levels`); an account
    without a row there starts with a full bucket. A request from before the time of its bucket's
    level counts as of that time.
    """
    for reserved in ("_ms", "_need", "_cap"):
        if reserved in requests.columns:
            raise ValueError(f"column name {reserved} is reserved")
    prepared = requests.withColumns({
        "_ms": F.unix_millis(F.col(at).cast("timestamp")),
        "_need": F.col(amount).cast("bigint"), "_cap": F.col(limit).cast("bigint")})
    if levels is not None:
        held = levels.select(F.col(account).alias("_owner"), F.col("level_ms").alias("_since"))
        prepared = prepared.join(held, F.col(account) == F.col("_owner"), "left").withColumn(
            "_ms", F.greatest("_ms", "_since")).drop("_owner", "_since")
    counted = (F.col("_need") > 0) & (F.col("_need") <= F.col("_cap"))
    laid = ordered_layout(prepared.where(counted), [account, *order_by], "bucket")

    starts = _start_levels(laid, account, period_ms, levels)
    runs = laid.join(starts, [account, PART], "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = level = last = None
        for batch in batches:
            at, need, cap = _columns(batch)
            admitted, left = np.empty(len(at), dtype=bool), np.empty(len(at), dtype=np.int64)
            for lo, hi, here in _runs(batch, account):
                if here != run:
                    run, level, last = here, batch.column("_start")[lo].as_py(), None
                admitted[lo:hi], left[lo:hi] = _decide(at[lo:hi], need[lo:hi], cap[lo:hi],
                                                       period_ms, level, last)
                level, last = int(left[hi - 1]), int(at[hi - 1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(admitted), pa.array(left)],
                names=[*batch.schema.names, "_admitted", "_left"])

    decided = _in_run_order(runs).mapInArrow(decide, f"{schema}, _admitted boolean, _left bigint")
    missing = (F.col("_need") * period_ms - F.col("_left")) / F.col("_cap")
    decided = decided.select(
        *requests.columns, F.col("_admitted").alias("allowed"),
        F.when(F.col("_admitted"), 0.0).otherwise(missing / F.lit(1000.0))
        .alias("retry_after_seconds"),
        (F.col("_left") / F.lit(period_ms)).alias("tokens_remaining"),
        F.lit(False).alias("unsatisfiable"))
    untouched = prepared.where(~F.coalesce(counted, F.lit(False))).select(
        *requests.columns, F.coalesce(F.col("_need") <= 0, F.lit(False)).alias("allowed"),
        F.when(F.col("_need") <= 0, 0.0).alias("retry_after_seconds"),
        F.when(F.col("_need") <= 0, F.col("_cap").cast("double")).alias("tokens_remaining"),
        F.when(F.col("_cap").isNull(), F.col("_need") > 0).otherwise(
            F.col("_need") > F.col("_cap")).alias("unsatisfiable"))
    return decided.unionByName(untouched)


def _touching(decided: DataFrame, amount: str) -> DataFrame:
    """Decisions that went through the bucket: not those for nothing or beyond the limit."""
    return decided.where((F.col(amount) > 0) & ~F.col("unsatisfiable"))


def bucket_levels(decided: DataFrame, account: str, order_by: Sequence[str], at: str, amount: str,
                  period_ms: int = MINUTE_MS) -> DataFrame:
    """State of every bucket after its last decided request: ``(account, level, level_ms)``."""
    last = _touching(decided, amount).groupBy(account).agg(
        F.max_by(F.struct("tokens_remaining", at), F.struct(*order_by)).alias("_s"))
    return last.select(
        account, F.round(F.col("_s.tokens_remaining") * period_ms).cast("bigint").alias("level"),
        F.unix_millis(F.col(f"_s.{at}").cast("timestamp")).alias("level_ms"))


def _start_levels(laid: DataFrame, account: str, period: int, levels: DataFrame | None
                  ) -> DataFrame:
    """Level at the first request of every run whose bucket is not simply full there."""
    parts = laid.groupBy(account, PART).agg(
        F.min_by("_ms", POS).alias("first_ms"), F.max_by("_ms", POS).alias("last_ms"),
        F.min_by("_cap", POS).alias("first_cap"))
    if levels is None:
        parts = parts.withColumn("initial", F.lit(None).cast("bigint"))
    else:
        elapsed = F.least(F.greatest(F.col("first_ms") - F.col("level_ms"), F.lit(0)),
                          F.lit(period))
        refilled = F.col("level") + elapsed * F.col("first_cap")
        parts = parts.join(levels.select(account, "level", "level_ms"), account, "left").select(
            account, PART, "first_ms", "last_ms", "first_cap",
            F.when(F.col("level").isNotNull(), F.least(refilled, F.col("first_cap") * period))
            .alias("initial"))
    # A part continues an account only if the account's rows fill its beginning, so at most one
    # account per part is concerned.
    heads = laid.where(F.col(POS) == 0).select(account).distinct()
    wide = (parts.join(heads, account, "left_semi").groupBy(account)
            .agg(F.count("*").alias("_n"), F.min(PART).alias("_first_part"),
                 F.max(PART).alias("_last_part"))
            .where(F.col("_n") > 1).select(account, "_first_part", "_last_part"))
    long_parts = parts.join(wide, account)
    full = F.col("first_cap") * period
    begins = F.coalesce("initial", full)
    first = F.col(PART) == F.col("_first_part")
    unknown = long_parts.where(F.col(PART) < F.col("_last_part")).select(
        account, PART, F.when(first, begins).otherwise(F.lit(0)).alias("_a"),
        F.when(first, begins).otherwise(full).alias("_b"))
    rows, kind = laid.select(account, PART, POS, "_ms", "_need", "_cap"), laid.schema[account].dataType
    key = f"`{account}` {laid.schema[account].dataType.simpleString()}"

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = bounds = last = None
        for batch in batches:
            at, need, cap = _columns(batch)
            for lo, hi, here in _runs(batch, account):
                if here != run:
                    if run is not None:
                        yield reached(run, bounds)
                    run, last = here, None
                    bounds = batch.column("_a")[lo].as_py(), batch.column("_b")[lo].as_py()
                bounds = _reach(at[lo:hi], need[lo:hi], cap[lo:hi], period, *bounds, last)
                last = int(at[hi - 1])
        if run is not None:
            yield reached(run, bounds)

    def reached(run, bounds) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([run[1]], to_arrow_type(kind)), pa.array([run[0]], pa.int32()),
             *(pa.array([b], pa.int64()) for b in bounds)], [account, PART, "low", "high"])

    ends = _in_run_order(rows.join(unknown, [account, PART])).mapInArrow(
        reach, f"{key}, {PART} int, low bigint, high bigint")

    def narrow(runs: pa.Table) -> pa.Table:
        # One row per run of the account: as many as the account has partitions.
        runs = runs.sort_by(PART)
        out, before = [], None
        for run in runs.select(["first_ms", "last_ms", "first_cap", "initial", "low", "high"]
                               ).to_pylist():
            most = run["first_cap"] * period
            if before is None:
                level = most if run["initial"] is None else run["initial"]
                out.append((level, level))
            else:
                refill = min(max(run["first_ms"] - before["last_ms"], 0), period) * run["first_cap"]
                out.append(tuple(min(most, before[side] + refill) for side in ("low", "high")))
            before = run
        low, high = zip(*out)
        return pa.table({account: runs[account], PART: runs[PART], "_a": pa.array(low, pa.int64()),
                         "_b": pa.array(high, pa.int64())})

    ranges = (long_parts.join(ends, [account, PART], "left").groupBy(account)
              .applyInArrow(narrow, f"{key}, {PART} int, _a bigint, _b bigint"))
    known = ranges.join(wide, account).where(F.col(PART) < F.col("_last_part")).select(
        account, PART, "_a", "_b")
    long_rows = rows.join(known, [account, PART])

    def effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pieces = last = None
        for batch in batches:
            at, need, cap = _columns(batch)
            for lo, hi, here in _runs(batch, account):
                if here != run:
                    if run is not None:
                        yield emit(run, pieces)
                    run, pieces, last = here, None, None
                    domain = batch.column("_a")[lo].as_py(), batch.column("_b")[lo].as_py()
                pieces = _run_effect(at[lo:hi], need[lo:hi], cap[lo:hi], period, pieces, last, domain)
                last = int(at[hi - 1])
        if run is not None:
            yield emit(run, pieces)

    def emit(run, pieces) -> pa.RecordBatch:
        columns = [pa.array([run[1]], to_arrow_type(kind)), pa.array([run[0]], pa.int32()),
                   *[pa.array([piece.tolist()]) for piece in pieces]]
        return pa.RecordBatch.from_arrays(columns, [account, PART, "start", "value", "moves"])

    effects = _in_run_order(long_rows).mapInArrow(
        effect, f"{key}, {PART} int, start array<bigint>, value array<bigint>, "
                f"moves array<boolean>")
    steps = long_parts.join(effects, [account, PART], "left")

    def chain(runs: pa.Table) -> pa.Table:
        # One row per run of the account: as many as the account has partitions.
        runs = runs.sort_by(PART)
        begins, level, last = [], None, None
        columns = ["first_ms", "last_ms", "first_cap", "initial", "start", "value", "moves"]
        for run in runs.select(columns).to_pylist():
            full = run["first_cap"] * period
            if level is None:
                level = full if run["initial"] is None else run["initial"]
            else:
                elapsed = min(max(run["first_ms"] - last, 0), period)
                level = min(full, level + elapsed * run["first_cap"])
            begins.append(level)
            last = run["last_ms"]
            if run["start"] is not None:
                i = bisect_right(run["start"], level) - 1
                level = run["value"][i] + (level if run["moves"][i] else 0)
        return pa.table({account: runs[account], PART: runs[PART], "_start": pa.array(begins)})

    chained = steps.groupBy(account).applyInArrow(chain, f"{key}, {PART} int, _start bigint")
    if levels is None:
        return chained
    single = parts.join(wide, account, "left_anti").where(F.col("initial").isNotNull())
    return chained.unionByName(single.select(account, PART, F.col("initial").alias("_start")))


def _in_run_order(rows: DataFrame) -> DataFrame:
    """Whole runs, one after the other, as a stream of batches: no run is held in memory."""
    return rows.repartition(PART).sortWithinPartitions(PART, POS)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy() for c in ("_ms", "_need", "_cap")]


def _runs(batch: pa.RecordBatch, account: str) -> Iterator[tuple[int, int, tuple]]:
    """Stretches of a batch that belong to one run, with the run's ``(part, account)``."""
    if batch.num_rows == 0:
        return
    part = batch.column(PART).to_numpy()
    owner = batch.column(account)
    code = owner.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(code) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield lo, hi, (int(part[lo]), owner[lo].as_py())


def with_limits(requests: DataFrame, accounts: DataFrame, account: str = "account_id",
                limit: str = "rate_limit_per_minute") -> DataFrame:
    """Requests with their account's limit; null for accounts that are not known."""
    return requests.join(accounts.select(account, limit), account, "left")


def admit_batches(batches: DataFrame, accounts: DataFrame, order_by: Sequence[str], at: str
                  ) -> DataFrame:
    """Entities-per-minute gate in front of batches: each asks for its entity count.

    ``unknown_account`` marks batches whose account has no limit; they are not admitted and never
    can be.
    """
    limited = with_limits(batches, accounts).withColumn(
        "unknown_account", F.col("rate_limit_per_minute").isNull())
    return token_bucket(limited, "account_id", order_by, at, "entity_count",
                        "rate_limit_per_minute")


def submission_limit(submissions: DataFrame, order_by: Sequence[str], at: str,
                     account: str = "account_id",
                     per_minute: int = DEFAULT_SUBMISSIONS_PER_MINUTE,
                     period_ms: int = MINUTE_MS) -> DataFrame:
    """Submissions-per-minute gate: every submission takes one token."""
    limited = submissions.withColumns({"_one": F.lit(1), "_limit": F.lit(per_minute)})
    return token_bucket(limited, account, order_by, at, "_one", "_limit", period_ms
                        ).drop("_one", "_limit")


def peek(decided: DataFrame, account: str, order_by: Sequence[str], at: str, amount: str,
         limit: str, now: Column, period_ms: int = MINUTE_MS,
         accounts: DataFrame | None = None) -> DataFrame:
    """Tokens each account could use at ``now``, from its last decided request. With
    ``accounts(account, limit)`` all of these are listed: one that has asked for nothing yet has
    its full limit."""
    last = _touching(decided, amount).groupBy(account).agg(
        F.max_by(F.struct("tokens_remaining", at, limit), F.struct(*order_by)).alias("_s"))
    elapsed = F.greatest(F.unix_millis(now.cast("timestamp"))
                         - F.unix_millis(F.col(f"_s.{at}").cast("timestamp")), F.lit(0))
    cap = F.col(f"_s.{limit}").cast("double")
    level = F.col("_s.tokens_remaining") + elapsed * cap / F.lit(period_ms)
    levels = last.select(account, F.least(cap, level).alias("tokens_available"))
    if accounts is None:
        return levels
    full = accounts.select(account, F.col(limit).cast("double").alias("_full"))
    return full.join(levels, account, "left").select(
        account, F.coalesce("tokens_available", "_full").alias("tokens_available"))


def deferrals(decided: DataFrame, at: str) -> DataFrame:
    """Denied requests stay pending and name the time of their next try."""
    delay = retry_after_ms("retry_after_seconds")
    return decided.where(~F.col("allowed") & ~F.col("unsatisfiable")).select(
        "*", F.lit("pending").alias("status"), delay.alias("retry_after_ms"),
        F.timestamp_millis(F.unix_millis(F.col(at).cast("timestamp")) + delay)
        .alias("next_try_at"))


def admission_timetable(requests: DataFrame, account: str, order_by: Sequence[str], amount: str,
                        limit: str) -> DataFrame:
    """Seconds until each request of a backlog is admitted when all wait in line, strictly in
    order. (The live gate lets a later, smaller request overtake; this timetable does not.)
    Requests above the limit are never admitted: they have no time and nobody waits for them.
    Requests for nothing take none."""
    takes = F.when((F.col(amount) > 0) & (F.col(amount) <= F.col(limit)), F.col(amount))
    summed = running_sum(requests, [account], order_by,
                         {"_ahead": F.coalesce(takes, F.lit(0)).cast("bigint")})
    wait = (F.col("_ahead") - F.col(limit)) / (F.col(limit) / F.lit(60.0))
    return summed.withColumn("admit_after_seconds", F.when(
        F.col(amount) <= F.col(limit), F.greatest(wait, F.lit(0.0)))).drop("_ahead")


def idle_timeout_ms(limit: Column, period_ms: int = MINUTE_MS) -> Column:
    """How long an untouched bucket is remembered: until it would be full again, plus a grace."""
    per_ms = limit / F.lit(period_ms)
    return F.ceil(limit / per_ms).cast("bigint") + IDLE_STATE_GRACE_MS

