"""Sharding by fixed virtual slots and a stored, versioned map from slots to shards.

Every record is hashed into one of some thousands of slots, for good. Bytes and rows are summed per
slot, and a map gives each slot a shard: the largest slot first, always to the shard with the fewest
bytes. The map is a small table with a version; rebalancing writes a next version that differs in
the slots that move. All sizes on the way are bounded by the number of slots, except the rows
themselves, which are never sorted by shard: a row's place is its slot's offset in the shard plus its
place among the slot's rows.

A record that is repeated until it outweighs a slot cannot be divided by its hash. Its copies are
dealt over all slots instead; there are at most as many such records as slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swathe.sources.staging import stage, staging_path

SLOTS = 4096


def place(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text"
          ) -> DataFrame:
    """Staged rows: key, size, text_crc32, and the virtual slot of each row of ``docs``.

    size is the UTF-8 length of the text plus 1 (null text: 1), text_crc32 the unsigned CRC of the
    text (null as empty). Null and repeated keys are rows like others. ``row`` tells equal rows
    apart; the table is written before it is used, so it stays the same when executors are lost.
    """
    value = F.coalesce(docs[text], F.lit(""))
    record = F.xxhash64(docs[key], docs[text])
    rows = stage(docs.select(
        docs[key].alias("key"), (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value).alias("text_crc32"), record.alias("record"),
        F.pmod(record, F.lit(slots)).cast("int").alias("own_slot"),
        F.monotonically_increasing_id().alias("row")), "slot-rows")

    # Repeated records heavier than an average slot, looked for in the heavy slots only.
    fair = F.lit(rows.agg(F.sum("size")).first()[0] or 0) / F.lit(slots)
    heavy = rows.groupBy("own_slot").agg(F.sum("size").alias("_b"), F.count("*").alias("_n")).where(
        (F.col("_b") > 2 * fair) & (F.col("_n") > 1)).select("own_slot")
    repeated = (rows.join(heavy, "own_slot", "left_semi").groupBy("record", "text_crc32")
                .agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
                .where((F.col("_b") > fair) & (F.col("_n") > 1))
                .select("record", "text_crc32", F.lit(True).alias("_dealt")))
    dealt = F.pmod(F.xxhash64("record", "row"), F.lit(slots)).cast("int")
    return rows.join(repeated, ["record", "text_crc32"], "left").select(
        "key", "size", "text_crc32", "record", "row",
        F.when(F.col("_dealt"), dealt).otherwise(F.col("own_slot")).alias("virtual_slot"))


def slot_weights(placed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of every slot, empty ones included; combined before the shuffle."""
    every = placed.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    held = placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"),
                                              F.count("*").alias("rows"))
    return every.join(held, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def _dealt(pool: Column, loads: Column) -> Column:
    """Array of (virtual_slot, shard): ``pool`` (by falling bytes) dealt one by one to the shard
    of ``loads`` with the fewest bytes, then slots."""
    def deal(state: Column, slot: Column) -> Column:
        least = F.array_min(state["loads"])
        loads = F.transform(state["loads"], lambda x: F.when(
            x["shard"] == least["shard"],
            F.struct((x["bytes"] + slot["bytes"]).alias("bytes"),
                     (x["slots"] + F.lit(1).cast("long")).alias("slots"),
                     x["shard"].alias("shard"))).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["out"], F.array(F.struct(
            slot["virtual_slot"].alias("virtual_slot"), least["shard"].alias("shard")))).alias("out"))

    start = F.struct(loads.alias("loads"), F.from_json(
        F.lit("[]"), "array<struct<virtual_slot:int,shard:int>>").alias("out"))
    return F.aggregate(pool, start, deal, lambda state: state["out"])


def _deal_slots(pool: DataFrame, loads: DataFrame) -> DataFrame:
    """(virtual_slot, shard) for the slots of ``pool``; ``loads`` has (shard, bytes, slots)."""
    none = F.lit(None)
    both = pool.select("virtual_slot", "bytes", none.cast("long").alias("slots"),
                       none.cast("int").alias("shard")).unionByName(
        loads.select(none.cast("int").alias("virtual_slot"), "bytes", "slots", "shard"))
    # One row with as many array elements as there are slots and shards. Nulls are not collected.
    one = both.agg(
        F.sort_array(F.collect_list(F.when(F.col("shard").isNull(), F.struct(
            (-F.col("bytes")).alias("_b"), "virtual_slot", "bytes")))).alias("pool"),
        F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct(
            "bytes", "slots", "shard")))).alias("loads"))
    falling = F.transform("pool", lambda s: F.struct(
        s["virtual_slot"].alias("virtual_slot"), s["bytes"].alias("bytes")))
    return one.select(F.explode(_dealt(falling, F.col("loads"))).alias("_d")).select("_d.*")


def _shards(spark: SparkSession, shards: int) -> DataFrame:
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"))


def create_map(weights: DataFrame, shards: int) -> DataFrame:
    """First map (virtual_slot, shard): sizes as near equal as whole slots allow."""
    zero = F.lit(0).cast("long")
    return _deal_slots(weights, _shards(weights.sparkSession, shards).select(
        "shard", zero.alias("bytes"), zero.alias("slots")))


def rebalance(current: DataFrame, weights: DataFrame, shards: int, slack: float = 0.01) -> DataFrame:
    """Next map for new weights or another number of shards.

    A shard keeps its slots, largest first, as far as they fit ``1 + slack`` of the mean; the others
    and those of shards that are gone are dealt to the emptiest shards. Nothing else moves.
    """
    spark = weights.sparkSession
    mean = weights.agg((F.sum("bytes") / F.lit(shards)).alias("_mean")).scalar()
    held = (weights.join(current, "virtual_slot", "left")
            .withColumn("shard", F.when(F.col("shard") < shards, F.col("shard"))))
    fill = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)  # at most as many rows as slots
    fits = F.sum("bytes").over(fill) <= mean * (1 + slack)
    decided = held.select("virtual_slot", "bytes", F.when(fits, F.col("shard")).alias("shard"))
    stays = decided.where(F.col("shard").isNotNull())
    loads = (_shards(spark, shards)
             .join(stays.groupBy("shard").agg(F.sum("bytes").alias("bytes"),
                                              F.count("*").alias("slots")), "shard", "left")
             .fillna(0, ["bytes", "slots"]))
    return stays.select("virtual_slot", "shard").unionByName(
        _deal_slots(decided.where(F.col("shard").isNull()), loads))


def store_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Write a version; a version that exists is never overwritten."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of a version, of the newest one by default."""
    versions = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == version).select("virtual_slot", "shard")


def moved_slots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(virtual_slot, shard, to_shard) of the slots that change hands between two maps."""
    return (before.join(after.withColumnRenamed("shard", "to_shard"), "virtual_slot")
            .where("shard <> to_shard"))


def assign(placed: DataFrame, slot_map: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows with their shard and their place in it, gapless from 0, in (slot, key) order."""
    before = (Window.partitionBy("shard").orderBy("virtual_slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = slot_map.join(weights, "virtual_slot").select(
        "virtual_slot", "shard",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("virtual_slot").orderBy("key", "record", "row")
    return (placed.withColumn("_place", F.row_number().over(inside))
            .join(offsets, "virtual_slot")
            .withColumn("place", (F.col("_offset") + F.col("_place") - 1).cast("long"))
            .drop("_place", "_offset"))


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, virtual_slot, shard, place of every row of ``docs``.

    The map is kept under ``path`` (a fresh folder of the staging area by default). Where it has
    no version yet the first is made; else the newest is edited where its shards have become
    unequal or their number differs, and stored as the next one. Sizes of shards come out equal to
    within one slot, or one document where that is larger. Null texts have size 1; null and
    repeated keys are rows like others; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    placed = place(docs, slots, key, text)
    weights = stage(slot_weights(placed, slots), "slot-weights")
    fresh = path is None
    path = path or staging_path(spark, "slot-map")
    newest = None if fresh else newest_version(spark, path)
    if newest is None:
        store_map(create_map(weights, shards), path, 1)
    else:
        current = load_map(spark, path, newest)
        after = stage(rebalance(current, weights, shards), "slot-map-edit")
        if not moved_slots(current, after).isEmpty():
            store_map(after, path, newest + 1)
    return assign(placed, load_map(spark, path), weights).select(
        F.col("key").alias(key), "size", "text_crc32", "virtual_slot", "shard", "place")


def newest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest stored version, None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    return spark.read.schema("virtual_slot int, shard int, version int").parquet(path).agg(
        F.max("version")).first()[0]
