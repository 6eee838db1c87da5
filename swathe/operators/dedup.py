"""First-wins de-duplication inside an action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from swathe.functions.text import normalise_key

UNIQUE, DUPLICATE, MISSING = "unique", "duplicate", "missing_key"


def _hash(key: str | Column) -> Column:
    return F.unhex(F.md5(key))


def mark_duplicates(rows: DataFrame, pk: str, field: str, order_by: Sequence[str],
                    ledger: DataFrame | None = None) -> DataFrame:
    """Add ``dedup_key`` and ``dedup_class`` (unique / duplicate / missing_key).

    The first row of a key in ``(*order_by, pk)`` order wins; rows without a key always pass.
    ``ledger(dedup_key, winner_pk)`` holds keys claimed before: such a key can only be won by the
    same row again, so repeating a run changes nothing.

    The winner per key is a combined ``min`` and comes back over the unique row key, so one
    de-duplication key held by a large share of the rows is neither sorted nor joined in a single
    task. Keys are grouped and joined by a 128-bit hash, so long ones are not shuffled.
    """
    order = [*(c for c in order_by if c != pk), pk]
    numeric = isinstance(rows.schema[field].dataType, NumericType)
    key = F.col(field).cast("string") if numeric else normalise_key(field)
    keyed = rows.withColumn("dedup_key", key)
    # min over one number aggregates in place; a struct is only needed for a composite order.
    first = F.min(pk) if order == [pk] else F.min(F.struct(*order))[pk]
    winners = (keyed.where(F.col("dedup_key").isNotNull())
               .groupBy(_hash("dedup_key").alias("_key")).agg(first.alias("_winner")))
    won = F.col(pk) == F.col("_winner")
    if ledger is None:
        winners = winners.select("_winner")
    else:
        claimed = ledger.select(_hash("dedup_key").alias("_claimed_key"),
                                F.col("winner_pk").alias("_claimed_by"))
        winners = (winners.join(claimed, F.col("_key") == F.col("_claimed_key"), "left")
                   .select("_key", F.coalesce("_claimed_by", "_winner").alias("_winner")))
        # A claim may name a row that carries another key by now.
        won = won & (_hash("dedup_key") == F.col("_key"))
    return keyed.join(winners, won, "left").select(
        *keyed.columns,
        F.when(F.col("dedup_key").isNull(), MISSING)
        .when(F.col("_winner").isNotNull(), UNIQUE)
        .otherwise(DUPLICATE).alias("dedup_class"))


def claimed_keys(marked: DataFrame, pk: str, action_id: str,
                 ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows ``(action_id, dedup_key, winner_pk)`` that this run adds."""
    new = marked.where(F.col("dedup_class") == UNIQUE).select(
        F.lit(action_id).alias("action_id"), "dedup_key", F.col(pk).alias("winner_pk"))
    if ledger is not None:
        new = new.join(ledger.select("action_id", "dedup_key"), ["action_id", "dedup_key"],
                       "left_anti")
    return new


def distinct_keys(rows: DataFrame, field: str) -> DataFrame:
    """Number of distinct keys after normalisation."""
    return rows.agg(F.countDistinct(_hash(normalise_key(field))).alias("distinct_keys"))
