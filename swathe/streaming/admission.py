"""Admission of requests as they arrive: token buckets, limits and replays on a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from swathe.operators.ratelimit import MINUTE_MS, _decide, bucket_levels, token_bucket
from swathe.sources.keyed import KeyedState
from swathe.sources.staging import stage

SLOTS = 512  # groups that keys are handed to Python in: a call for each key costs more than its rows


def limits_join(requests: DataFrame, accounts: DataFrame, account: str = "account_id",
                limit: str = "rate_limit_per_minute") -> DataFrame:
    """Stream-static lookup of each request's account limit; null for unknown accounts."""
    return requests.join(accounts.select(account, limit), account, "left")


def token_bucket_stream(requests: DataFrame, account: str, ids: Sequence[str], at: str,
                        amount: str, limit: str, period_ms: int = MINUTE_MS) -> DataFrame:
    """:func:`swathe.operators.ratelimit.token_bucket` on a stream; ``at`` is a timestamp.

    Every request gets a decision, however late it comes: time never runs backwards in a bucket,
    so a late one adds no tokens. State per account is the bucket's level and time, kept for good in
    ``SLOTS`` slots by the account's hash: requests may come late by any time. A request without a limit (unknown account)
    is ``unsatisfiable``. Rows are decided in ``(at, *ids)`` order within a trigger and in arrival
    order between triggers; a trigger's size (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``)
    bounds the rows of one slot's accounts held at a time.
    """
    prepared = requests.select(
        F.col(account), *[F.col(c) for c in ids], F.col(at),
        F.unix_millis(at).alias("_ms"), F.col(amount).cast("bigint").alias("_need"),
        F.col(limit).cast("bigint").alias("_cap"),
        F.coalesce(F.col(account).cast("string"), F.lit("")).alias("_who"),
        _slot([account]).alias("_slot"))
    kinds = {f.name: f.dataType.simpleString() for f in prepared.schema}
    schema = ", ".join([
        *[f"`{c}` {kinds[c]}" for c in (account, *ids)],
        "allowed boolean, retry_after_seconds double, tokens_remaining double, "
        "unsatisfiable boolean"])

    def decide(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState
               ) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["_who", at, *ids])
        held = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        counted = ((pdf["_need"] > 0) & (pdf["_need"] <= pdf["_cap"])).to_numpy()
        out = pdf[[account, *ids]].copy()
        nothing = (pdf["_need"] <= 0).to_numpy()
        out["allowed"] = nothing
        out["retry_after_seconds"] = np.where(nothing, 0.0, np.nan)
        out["tokens_remaining"] = np.where(nothing, pdf["_cap"].to_numpy(float), np.nan)
        out["unsatisfiable"] = ~(counted | nothing)
        if counted.any():
            used = pdf[counted]
            need, caps, ms = (used[c].to_numpy("int64") for c in ("_need", "_cap", "_ms"))
            who = used["_who"].to_numpy(object)
            admitted, levels = np.empty(len(used), dtype=bool), np.empty(len(used), dtype=np.int64)
            cuts = np.flatnonzero(who[1:] != who[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(used)]):
                level, last = held.get(who[lo], (None, None))
                admitted[lo:hi], levels[lo:hi] = _decide(ms[lo:hi], need[lo:hi], caps[lo:hi],
                                                         period_ms, level, last)
                newest = int(ms[lo:hi].max())
                held[who[lo]] = (int(levels[hi - 1]), newest if last is None else max(newest, last))
            out.loc[counted, "allowed"] = admitted
            wait = (need * period_ms - levels) / caps / 1000.0
            wait[admitted] = 0.0
            out.loc[counted, "retry_after_seconds"] = wait
            out.loc[counted, "tokens_remaining"] = levels / period_ms
            state.update((list(held), *map(list, zip(*held.values()))))
        yield out

    return prepared.groupBy("_slot").applyInPandasWithState(
        decide, schema, "who array<string>, level array<bigint>, last array<bigint>", "append",
        GroupStateTimeout.NoTimeout)


def _slot(keys: Sequence[str]) -> Column:
    """Keys are handed to Python by slots, many in a call; those with a null have one of their own."""
    some_null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return F.when(some_null, F.lit(-1).cast("long")).otherwise(
        F.pmod(F.xxhash64(*keys), F.lit(SLOTS)))


def bucket_step(account: str, ids: Sequence[str], at: str, amount: str, limit: str, out: str,
                state: str, period_ms: int = MINUTE_MS) -> Callable[[DataFrame, int], None]:
    """Trigger function deciding requests with the parallel batch form of the bucket.

    The same decisions as :func:`token_bucket_stream`, late requests included, for streams in
    which one account may send more per trigger than one task should hold. Levels are kept for good
    below ``state`` as :class:`swathe.sources.keyed.KeyedState`, of which a trigger opens the buckets
    of its own accounts; decisions go below ``out``.
    """
    order = [at, *ids]

    def run(requests: DataFrame, trigger: int) -> None:
        held = KeyedState(requests.sparkSession, state, [account])
        held.compact(trigger)
        before = held.lookup(requests.select(account), trigger)
        if before is not None:
            before = stage(before.select(account, "level", "level_ms"), "levels")
        decided = stage(token_bucket(requests, account, order, at, amount, limit, period_ms,
                                     before), "decided")
        now = bucket_levels(decided, account, order, at, amount, period_ms)
        if before is not None:  # a late request does not turn the bucket's time back
            since = before.select(F.col(account).alias("_owner"), F.col("level_ms").alias("_since"))
            now = now.join(since, F.col(account) == F.col("_owner"), "left").select(
                account, "level", F.greatest("level_ms", "_since").alias("level_ms"))
        held.write(trigger, now)
        decided.write.mode("overwrite").parquet(f"{out}/batch={trigger}")
    return run


def idempotent_stream(submissions: DataFrame, keys: Sequence[str], at: str, pk: str = "id"
                      ) -> DataFrame:
    """The submissions that are not repeats: the first of every key, by ``(at, pk)`` within a
    trigger and by arrival between triggers, however long ago that was.

    The last of ``keys`` is the idempotency key; submissions in which it is null or empty are
    never repeats. One flag per key is kept for good.
    """
    keyed = (F.col(keys[-1]) != "") & F.col(keys[-1]).isNotNull()

    def first(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState
              ) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            both = pdf if best is None else pd.concat([best, pdf])
            best = both.sort_values([at, pk]).drop_duplicates("_who")
        seen = state.get[0] if state.exists else []
        fresh = None if best is None else best[~best["_who"].isin(seen)]
        if fresh is not None and len(fresh):
            state.update((list(seen) + fresh["_who"].tolist(),))
            yield fresh.drop(columns=["_who", "_slot"])

    marked = submissions.where(keyed).select(
        "*", F.to_json(F.struct(*keys)).alias("_who"), _slot(keys).alias("_slot"))
    firsts = marked.groupBy("_slot").applyInPandasWithState(
        first, submissions.schema, "seen array<string>", "append", GroupStateTimeout.NoTimeout)
    return firsts.unionByName(submissions.where(~keyed | F.col(keys[-1]).isNull()))
