"""Which rows an action is about."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.functions.predicates import compile_filter
from swathe.model import EntitySpec


def target_predicate(df: DataFrame, entity: EntitySpec, account: Any,
                     filters: Mapping[str, Any] | None = None,
                     include_deleted: bool = False) -> Column:
    """Account scope, live rows only (unless told otherwise) and the filter, as one predicate."""
    predicate = in_scope(df, entity, account, include_deleted)
    return predicate & compile_filter(entity, filters, df)


def in_scope(df: DataFrame, entity: EntitySpec, account: Any,
             include_deleted: bool = False) -> Column:
    scope = F.col(entity.account) == F.lit(account)
    if entity.soft_delete and entity.soft_delete in df.columns and not include_deleted:
        scope = scope & F.col(entity.soft_delete).isNull()
    return scope


def readable(df: DataFrame, entity: EntitySpec) -> list[str]:
    return [c for c in entity.columns if c in df.columns]


def select_targets(df: DataFrame, entity: EntitySpec, account: Any,
                   filters: Mapping[str, Any] | None = None,
                   include_deleted: bool = False) -> DataFrame:
    """Declared columns of the rows an action with this filter would touch."""
    return (df.where(target_predicate(df, entity, account, filters, include_deleted))
            .select(*readable(df, entity)))


def select_by_ids(df: DataFrame, entity: EntitySpec, account: Any, ids: DataFrame,
                  include_deleted: bool = False) -> DataFrame:
    """Declared columns of the requested ids that live in the account; foreign ids match nothing.

    A plain semi join: Spark broadcasts the ids when their measured size allows it and shuffles
    both sides otherwise.
    """
    return (df.where(in_scope(df, entity, account, include_deleted))
            .join(ids.select(entity.pk), entity.pk, "left_semi")
            .select(*readable(df, entity)))


def id_range(df: DataFrame, pk: str, start: Any, end: Any) -> DataFrame:
    """Rows of an inclusive key range (reaches the scan as two pushed comparisons)."""
    return df.where(F.col(pk).between(F.lit(start), F.lit(end)))


def ids_frame(spark: SparkSession, ids: Sequence[Any], pk: str, dtype: str) -> DataFrame:
    """A request's id list as a table with its positions."""
    return spark.createDataFrame(list(enumerate(ids)), f"pos bigint, {pk} {dtype}")


def list_entities(df: DataFrame, entity: EntitySpec, account: Any = None,
                  status: str | None = None, include_deleted: bool = False,
                  status_column: str = "status") -> DataFrame:
    """Listing of an entity table; page it with :func:`swathe.operators.paging.offset_page`."""
    if account is not None:
        df = df.where(F.col(entity.account) == F.lit(account))
    if status is not None and status_column in df.columns:
        df = df.where(F.col(status_column) == F.lit(status))
    if entity.soft_delete and entity.soft_delete in df.columns and not include_deleted:
        df = df.where(F.col(entity.soft_delete).isNull())
    return df.select(*readable(df, entity))
