"""Pages of sorted rows: near the beginning one top-k over the filtered scan, at any depth by a
directory of ranks."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.sources.staging import release, stage


def keyset_page(df: DataFrame, key: str, limit: int, cursor: Any = None) -> DataFrame:
    """Rows after ``cursor`` in key order, at most ``limit``, with ``has_more`` and
    ``next_cursor`` (null on the last page).

    One row beyond the page tells whether more follow; the window sees ``limit + 1`` rows.
    """
    if cursor is not None:
        df = df.where(F.col(key) > F.lit(cursor))
    ahead = df.orderBy(key).limit(limit + 1)
    everything = Window.partitionBy(F.lit(1))
    numbered = ahead.withColumns({
        "_n": F.row_number().over(everything.orderBy(key)),
        "_count": F.count("*").over(everything)})
    last = F.max(F.when(F.col("_n") <= limit, F.col(key))).over(everything)
    more = F.col("_count") > limit
    return (numbered.withColumns({"has_more": more, "next_cursor": F.when(more, last)})
            .where(F.col("_n") <= limit).drop("_n", "_count"))


def offset_page(df: DataFrame, order_by: Sequence[Column | str], limit: int, offset: int = 0
                ) -> DataFrame:
    """Rows ``offset .. offset + limit`` in the given order, with the ``total`` of the filter and
    whether more rows follow."""
    total = df.agg(F.count("*").alias("n")).scalar()
    page = df.orderBy(*order_by).offset(offset).limit(limit).withColumn("total", total)
    return page.withColumn("has_more", F.col("total") > offset + limit)


class Pages:
    """Pages of one order at any depth.

    The rows are sorted once over all tasks and written with their place; a directory holds how many
    rows each part has. A page reads the parts that the directory names, and of these the rows of
    the page alone: no task sorts or skips what comes before it.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[Column | str]) -> None:
        """``order_by`` is a total order (add the key as the last column)."""
        laid = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
                .withColumn("_mid", F.monotonically_increasing_id()))
        self._rows = stage(laid, "pages")
        part = F.shiftright("_mid", 33)
        found = self._rows.groupBy(part.alias("part")).agg(
            F.count("*").alias("n")).orderBy("part").collect()  # a row per part
        self._parts = [(r["part"] << 33, r["n"]) for r in found]
        self.total = sum(n for _, n in self._parts)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset .. offset + limit`` in order, with ``total`` and ``has_more``."""
        wanted, before = F.lit(False), 0
        for first, n in self._parts:
            low, high = max(0, offset - before), min(n, offset + limit - before)
            if low < high:
                wanted = wanted | F.col("_mid").between(first + low, first + high - 1)
            before += n
        return self._rows.where(wanted).orderBy("_mid").drop("_mid").withColumns({
            "total": F.lit(self.total).cast("long"),
            "has_more": F.lit(self.total > offset + limit)})

    def release(self) -> None:
        release(self._rows)


def log_filter(logs: DataFrame, status: str | None = None, reason_code: str | None = None,
               entity_id: Any = None, action_id: Any = None) -> DataFrame:
    """Audit rows of an action by status, reason and entity."""
    wanted = {"action_id": action_id, "status": status, "reason_code": reason_code,
              "entity_id": entity_id}
    for column, value in wanted.items():
        if value is not None:
            logs = logs.where(F.col(column) == F.lit(value))
    return logs


def action_filter(actions: DataFrame, account_id: Any = None, status: str | None = None,
                  entity_type: str | None = None, action_type: str | None = None) -> DataFrame:
    """Actions by account, status, entity and action type."""
    wanted = {"account_id": account_id, "status": status, "entity_type": entity_type,
              "action_type": action_type}
    for column, value in wanted.items():
        if value is not None:
            actions = actions.where(F.col(column) == F.lit(value))
    return actions


def newest_first(df: DataFrame, created: str, tie: str) -> list[Column]:
    """Sort order of action and account listings; the id breaks ties, so pages are stable."""
    return [F.col(created).desc(), F.col(tie)]
