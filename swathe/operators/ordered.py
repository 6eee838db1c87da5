"""Order-dependent operators that scale: rank, running sum, previous row, carry-forward, median.

``row_number().over(Window.orderBy(k))`` sends every row to one task, and
``Window.partitionBy(k)`` sends a whole key to one task, which fails when one key holds a large
share of the rows. Everything here instead goes through :func:`ordered_layout`: rows are range
partitioned by the full sort key (a hot key is cut into many ranges), sorted and staged with their
partition number and position. Each operator then works inside the parts and adds what earlier
parts contribute. That contribution is one row per part, so the only unpartitioned windows run
over at most as many rows as there are shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.sources.staging import stage

PART, POS = "_part", "_pos"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of two column lists (true for empty lists)."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)), F.lit(True))


def ordered_layout(df: DataFrame, order_by: Sequence[str], name: str = "layout") -> DataFrame:
    """Stage ``df`` in global ``order_by`` order with ``_part`` and ``_pos`` (0-based) columns.

    ``order_by`` must be unique per row for the positions to be reproducible. The layout is
    written before it is used twice, so that counting the parts and numbering the rows see the
    same partitioning even if executors are lost in between.
    """
    mid = F.monotonically_increasing_id()
    laid = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
            .withColumn("_mid", mid))
    staged = stage(laid, name)
    return staged.select(
        *df.columns,
        F.shiftright("_mid", _ROW_BITS).cast("int").alias(PART),
        F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(POS),
    )


def _earlier_parts() -> Window:
    # One row per part: bounded by the number of shuffle partitions.
    return Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def global_rank(df: DataFrame, order_by: Sequence[str], out: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in ``order_by`` order (unique sort key)."""
    laid = ordered_layout(df, order_by, "rank")
    sizes = laid.groupBy(PART).agg((F.max(POS) + 1).alias("_size"))
    # Staged as well: every later use of the rank then reads this one-row-per-part table instead
    # of scanning all rows again to count the parts.
    offsets = stage(sizes.select(
        PART, F.coalesce(F.sum("_size").over(_earlier_parts()), F.lit(0)).alias("_offset")),
        "offsets")
    return (laid.join(offsets, PART)
            .withColumn(out, F.col("_offset") + F.col(POS) + 1)
            .drop(PART, POS, "_offset"))


def _is_head(keys: Sequence[str]) -> Column:
    return same([F.col(k) for k in keys], [F.col(f"_head_{k}") for k in keys])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    sums: Mapping[str, str | Column],
) -> DataFrame:
    """Add inclusive running sums per ``keys`` in ``order_by`` order; ``sums`` maps new names to
    numeric columns. ``(*keys, *order_by)`` must be unique."""
    values = {out: (F.col(c) if isinstance(c, str) else c) for out, c in sums.items()}
    df = df.select("*", *[v.alias(f"_v_{out}") for out, v in values.items()])
    laid = ordered_layout(df, [*keys, *order_by], "running")

    inside = (Window.partitionBy(PART, *keys).orderBy(POS)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Only the first key of a part can have rows in earlier parts.
    heads = laid.where(F.col(POS) == 0).select(
        F.col(PART).alias("_head_part"), *[F.col(k).alias(f"_head_{k}") for k in keys])
    totals = laid.groupBy(PART, *keys).agg(
        *[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in values])
    if keys:
        head_keys = heads.select([f"_head_{k}" for k in keys]).distinct()
        totals = totals.join(head_keys, _is_head(keys), "left_semi")
        before = (Window.partitionBy(*keys).orderBy(PART)
                  .rowsBetween(Window.unboundedPreceding, -1))
    else:
        before = _earlier_parts()
    spans = totals.select(
        PART, *keys,
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_c_{out}")
          for out in values])
    in_part = F.col(PART) == F.col("_head_part")
    carries = spans.join(heads, in_part & _is_head(keys)).drop(PART, *keys)

    joined = laid.join(carries, in_part, "left")
    carried = F.col("_head_part").isNotNull() & _is_head(keys)
    out_columns = [
        (F.sum(f"_v_{out}").over(inside)
         + F.when(carried, F.coalesce(F.col(f"_c_{out}"), F.lit(0))).otherwise(F.lit(0))
         ).alias(out)
        for out in values
    ]
    keep = [c for c in df.columns if not c.startswith("_v_")]
    return joined.select(*keep, *out_columns)


def rank_within(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str = "rank"
) -> DataFrame:
    """1-based row number per ``keys``; a key may be larger than one task."""
    return running_sum(df, keys, order_by, {out: F.lit(1).cast("bigint")})


def previous_row(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Mapping[str, str]
) -> DataFrame:
    """Add, per ``columns`` (new name -> column), the value in the preceding row of the same key."""
    laid = ordered_layout(df, [*keys, *order_by], "previous")
    row = F.struct(*[F.col(k).alias(f"k_{k}") for k in keys],
                   *[F.col(c).alias(f"v_{out}") for out, c in columns.items()])
    lasts = laid.groupBy(PART).agg(F.max_by(row, POS).alias("_row"))
    seeds = lasts.select(PART, F.lag("_row").over(Window.orderBy(PART)).alias("_seed"))
    inside = Window.partitionBy(PART).orderBy(POS)
    prev = laid.join(seeds, PART).withColumn(
        "_prev", F.coalesce(F.lag(row).over(inside), F.col("_seed")))
    matches = same([F.col(k) for k in keys], [F.col(f"_prev.k_{k}") for k in keys])
    matches = matches & F.col("_prev").isNotNull()
    return prev.select(
        *df.columns, *[F.when(matches, F.col(f"_prev.v_{out}")).alias(out) for out in columns])


def carry_forward(df: DataFrame, order_by: Sequence[str], marker: str, out: str) -> DataFrame:
    """Add the last non-null ``marker`` at or before each row in ``order_by`` order."""
    laid = ordered_layout(df, order_by, "carry")
    marks = laid.where(F.col(marker).isNotNull())
    lasts = marks.groupBy(PART).agg(F.max_by(marker, POS).alias("_last"))
    parts = laid.groupBy(PART).agg(F.max(POS).alias("_end"))
    seeds = parts.join(lasts, PART, "left").select(
        PART, F.last("_last", ignorenulls=True).over(_earlier_parts()).alias("_seed"))
    inside = (Window.partitionBy(PART).orderBy(POS)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return laid.join(seeds, PART).select(
        *df.columns,
        F.coalesce(F.last(marker, ignorenulls=True).over(inside), F.col("_seed")).alias(out))


def median_within(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str],
                  out: str = "median") -> DataFrame:
    """Exact median of the non-null ``value`` per key: rank, then average the middle one or two
    rows. ``tie`` makes ``(value, *tie)`` unique within a key."""
    ranked = rank_within(df.where(F.col(value).isNotNull()), keys, [value, *tie], "_rank")
    counts = ranked.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = ranked.join(counts, [*keys]) if keys else ranked.withColumn(
        "_n", counts.select("_n").scalar())
    middle = ((F.col("_rank") == F.floor((F.col("_n") + 1) / 2))
              | (F.col("_rank") == F.floor((F.col("_n") + 2) / 2)))
    return joined.where(middle).groupBy(*keys).agg(F.avg(value).alias(out))


def mark_first(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], pk: str, out: str = "is_first"
) -> DataFrame:
    """Flag the first row of every key, in ``(*order_by, pk)`` order; rows with a null key column
    are flagged too (they are nobody's duplicate).

    The winner is found by a map-side combined ``min`` and joined back on the unique ``pk``, so a
    key held by a third of all rows is neither sorted nor joined in one task.
    """
    order = [*order_by, pk] if pk not in order_by else list(order_by)
    present = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    columns = df.columns
    winners = (df.where(present).groupBy(*keys)
               .agg(F.min(F.struct(*order)).alias("_w")).select(F.col(f"_w.{pk}").alias("_w_pk")))
    return df.join(winners, F.col(pk) == F.col("_w_pk"), "left").select(
        *columns, (F.col("_w_pk").isNotNull() | ~present).alias(out))
