"""Connected components of a link table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from swathe.sources.staging import release, stage


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "_m").alias("m"))


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written once, with their count and hash, which are summed while they are written."""
    seen = Observation()
    out = stage(edges.observe(
        seen, F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), "edges")
    return out, (seen.get["rows"], seen.get["hash"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link that joins two different nodes; component is
    the smallest node that can be reached.

    Each step replaces neighbours by the smallest one (the minimum is combined before the
    shuffle), so stars form and chains halve: the number of steps is logarithmic in the number of
    nodes. Every step is written to shared storage and compared by count and hash with the last.
    Links with nulls join nothing; an empty table gives an empty result.
    """
    edges, state = _staged(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        small = _with_least(large)
        last, before = edges, state
        edges, state = _staged(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        release(last)
        if state == before:
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
                         .distinct()))
