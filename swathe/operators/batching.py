"""Target sets as numbered batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.operators.ordered import carry_forward, global_rank


def _index(rank: str, batch_size: int) -> Column:
    return F.expr(f"({rank} - 1) div {int(batch_size)}")


def assign_batches(targets: DataFrame, pk: str, batch_size: int) -> DataFrame:
    """Add ``batch_index``: consecutive runs of ``batch_size`` rows in key order."""
    return (global_rank(targets, [pk], "_rank")
            .withColumn("batch_index", _index("_rank", batch_size)).drop("_rank"))


def summarise_batches(assigned: DataFrame, pk: str) -> DataFrame:
    """One row per batch: key range and size, as stored in the plan."""
    return assigned.groupBy("batch_index").agg(
        F.min(pk).alias("cursor_start"),
        F.max(pk).alias("cursor_end"),
        F.count("*").alias("entity_count"),
    ).withColumn("status", F.lit("pending"))


def plan_batches(targets: DataFrame, pk: str, batch_size: int) -> DataFrame:
    """Batch plan of a filtered target set: disjoint inclusive key ranges in key order."""
    return summarise_batches(assign_batches(targets.select(pk), pk, batch_size), pk)


def assign_ids(ids: DataFrame, pk: str, batch_size: int, pos: str = "pos") -> DataFrame:
    """Batches of an explicit id list: repeated ids keep their first position, batches follow the
    request order."""
    firsts = ids.groupBy(pk).agg(F.min(pos).alias(pos))
    return (global_rank(firsts, [pos], "_rank")
            .withColumn("batch_index", _index("_rank", batch_size)).select(pk, "batch_index"))


def plan_from_ids(ids: DataFrame, pk: str, batch_size: int, pos: str = "pos") -> DataFrame:
    """Batch plan of an explicit id list; a batch holds its ids (at most ``batch_size``) sorted."""
    assigned = assign_ids(ids, pk, batch_size, pos)
    return assigned.groupBy("batch_index").agg(
        F.array_sort(F.collect_list(pk)).alias("entity_ids"),
        F.min(pk).alias("cursor_start"),
        F.max(pk).alias("cursor_end"),
        F.count("*").alias("entity_count"),
    ).withColumn("status", F.lit("pending"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """Entities and batches of a plan."""
    return plan.agg(F.coalesce(F.sum("entity_count"), F.lit(0)).alias("total_entities"),
                    F.count("*").alias("total_batches"))


def resolve_batches(rows: DataFrame, pk: str, plan: DataFrame) -> DataFrame:
    """Rows inside the key range of a stored batch, with their ``batch_index``.

    Ranges are disjoint, so the only candidate for a row is the last range starting at or before
    its key. That is a merge of both inputs in key order instead of a nested-loop range join.
    """
    markers = plan.select(
        F.col("cursor_start").alias(pk), F.lit(0).alias("_kind"),
        F.struct("batch_index", "cursor_end").alias("_range"))
    merged = (rows.withColumn("_kind", F.lit(1))
              .unionByName(markers, allowMissingColumns=True))
    filled = carry_forward(merged, [pk, "_kind"], "_range", "_batch")
    return (filled.where((F.col("_kind") == 1) & (F.col(pk) <= F.col("_batch.cursor_end")))
            .select(*rows.columns, F.col("_batch.batch_index").alias("batch_index")))


def drift_rows(plan: DataFrame, live: DataFrame) -> DataFrame:
    """One row per planned entity that is no longer there: ``live`` carries ``batch_index``.

    Which entity left is unknown, only how many did. Rows that joined a range after planning give
    no negative drift.
    """
    counts = live.groupBy("batch_index").agg(F.count("*").alias("_live"))
    missing = F.col("entity_count") - F.coalesce(F.col("_live"), F.lit(0))
    return (plan.join(counts, "batch_index", "left")
            .where(missing > 0)
            .select("batch_index", F.explode(F.sequence(F.lit(1).cast("bigint"), missing))
                    .alias("drift_no")))


def new_batches(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Plan rows whose ``(action_id, batch_index)`` is not stored yet: planning twice adds none."""
    return plan.join(existing.select("action_id", "batch_index"),
                     ["action_id", "batch_index"], "left_anti")


def unfinished_batches(plan: DataFrame, completed: DataFrame) -> DataFrame:
    """Batches still to run: completed ones are skipped when work is delivered again."""
    return plan.join(completed.select("action_id", "batch_index"),
                     ["action_id", "batch_index"], "left_anti")
