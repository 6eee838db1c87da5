"""Derived numbers of the accounting tables as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from swathe.model import DEFAULT_BATCH_SIZE, MAX_BATCH_SIZE, RETRY_CUSHION_MS


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def progress_percent(processed: Column | str, total: Column | str,
                     finished: Column | None = None) -> Column:
    """Processed share in percent, two decimals. An empty target set is 0, or 100 once finished."""
    p, t = _col(processed), F.coalesce(_col(total), F.lit(0))
    empty = F.lit(0.0) if finished is None else F.when(finished, F.lit(100.0)).otherwise(0.0)
    return F.when(t == 0, empty).otherwise(F.round(p / F.nullif(t, F.lit(0)) * 100, 2))


def duration_seconds(started: Column | str, finished: Column | str, now: Column | None = None) -> Column:
    """Seconds from start to finish (or ``now`` while running), never negative; null when not
    started. Zone-less times are UTC; another session zone would read them differently and is
    refused."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") not in UTC_NAMES:
        raise ValueError("set spark.sql.session.timeZone to UTC")
    end = _col(finished) if now is None else F.coalesce(_col(finished), now)
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(_col(started).cast("timestamp"))
    return F.greatest(micros / F.lit(1e6), F.when(micros.isNotNull(), F.lit(0.0)))


def per_minute(processed: Column | str, seconds: Column | str) -> Column:
    """Throughput per minute, two decimals; null without elapsed time or without work."""
    p, s = _col(processed), _col(seconds)
    return F.when((s > 0) & (p > 0), F.round(p / F.nullif(s, F.lit(0.0)) * 60, 2))


def pending(total: Column | str, processed: Column | str) -> Column:
    return F.greatest(F.coalesce(_col(total), F.lit(0)) - _col(processed), F.lit(0).cast("bigint"))


def retry_after_ms(seconds: Column | str) -> Column:
    """Delay before a denied request is tried again, with a small cushion."""
    return F.floor(_col(seconds) * 1000).cast("bigint") + RETRY_CUSHION_MS


def effective_batch_size(requested: Column | str, limit_per_minute: Column | str) -> Column:
    """Requested size (0 or null: the default), clamped to the maximum and to what the account's
    limit can ever admit; at least 1."""
    size = F.coalesce(F.nullif(_col(requested), F.lit(0)), F.lit(DEFAULT_BATCH_SIZE))
    return F.greatest(F.lit(1), F.least(size.cast("bigint"), F.lit(MAX_BATCH_SIZE),
                                        _col(limit_per_minute))).cast("bigint")


def batch_size_of(requested: int | None, limit_per_minute: int) -> int:
    """:func:`effective_batch_size` for one request."""
    return max(1, min(requested or DEFAULT_BATCH_SIZE, MAX_BATCH_SIZE, limit_per_minute))
