"""Live progress of actions from their growing audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from swathe.functions.measures import progress_percent
from swathe.model import TERMINAL_STATUSES
from swathe.operators.accounting import outcome_counts
from swathe.sources.keyed import KeyedState


def outcome_stream(spark: SparkSession, path: str, schema: StructType,
                   files_per_trigger: int = 1_000) -> DataFrame:
    """Audit rows as they are appended below ``path``."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def progress_stream(outcomes: DataFrame, totals: DataFrame) -> DataFrame:
    """Latest counters per action; ``totals(action_id, total_entities)`` is a static table.

    State is one row of counters per action. ``is_terminal`` marks actions that need no further
    updates. Use output mode ``update`` (changed actions) or ``complete`` (all).
    """
    counts = outcomes.groupBy("action_id").agg(*outcome_counts())
    joined = counts.join(totals.select("action_id", "total_entities"), "action_id", "left")
    total = F.coalesce("total_entities", F.lit(0).cast("bigint"))
    status = (F.when(F.col("processed_count") < total, "processing")
              .when(F.col("failure_count") > 0, "completed_with_errors").otherwise("completed"))
    return joined.select(
        "action_id", status.alias("status"), total.alias("total_entities"), "processed_count",
        "success_count", "failure_count", "skipped_count",
        progress_percent("processed_count", total,
                         F.lit(True)).alias("progress_percent"),
        status.isin(*TERMINAL_STATUSES).alias("is_terminal"))


def start_progress(progress: DataFrame, path: str, checkpoint: str, once: bool = False
                   ) -> StreamingQuery:
    """Publish progress: every trigger writes a frame of the actions that changed.

    Frames are runs of a :class:`swathe.sources.keyed.KeyedState`: a repeated trigger replaces its
    own, and older ones are merged, so what a reader has to look at does not grow with the triggers.
    """
    def publish(frame: DataFrame, trigger: int) -> None:
        frames = KeyedState(frame.sparkSession, path, ["action_id"], version="frame")
        frames.compact(trigger)
        frames.write(trigger, frame)

    writer = (progress.writeStream.outputMode("update").foreachBatch(publish)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_progress(frames: DataFrame) -> DataFrame:
    """Newest published state per action, from the frames written by :func:`start_progress`."""
    columns = [c for c in frames.columns if c not in ("action_id", "frame", "run", "bucket")]
    newest = frames.groupBy("action_id").agg(F.max_by(F.struct(*columns), "frame").alias("_f"))
    return newest.select("action_id", "_f.*")
