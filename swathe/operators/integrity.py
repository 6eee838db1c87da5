"""Constraint checks as reports of violations (empty when the table is sound)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_vocabulary(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the vocabulary and how often they occur."""
    return (df.where(~F.col(column).isin(*allowed))
            .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. Like a unique index, keys with a null never clash."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference has no parent."""
    refs = parent.select(F.col(key).alias("_parent_key"))
    return (child.where(F.col(column).isNotNull())
            .join(refs, F.col(column) == F.col("_parent_key"), "left_anti"))


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one row per checked column, in one scan."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], [F.col(c) for c in columns], "column_name", "nulls")
