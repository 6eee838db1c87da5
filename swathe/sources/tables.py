"""Reading and writing the library's tables as Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.model import ActionSpec, EntitySpec
from swathe.operators.targets import readable
from swathe.sources.staging import stage


def read_entity(spark: SparkSession, path: str, entity: EntitySpec, account: Any = None
                ) -> DataFrame:
    """Declared columns of an entity table. With a table partitioned by account, ``account``
    prunes to one partition; otherwise it is a pushed filter."""
    df = spark.read.parquet(path)
    if account is not None:
        df = df.where(F.col(entity.account) == F.lit(account))
    extra = [c for c in (entity.account, entity.updated_at)
             if c and c in df.columns and c not in entity.columns]
    return df.select(*readable(df, entity), *extra)


def account(accounts: DataFrame, account_id: Any) -> DataFrame:
    """One account (at most one row)."""
    return accounts.where(F.col("account_id") == F.lit(account_id))


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def append_outcomes(outcomes: DataFrame, path: str) -> None:
    """Append audit rows, one folder per action."""
    outcomes.write.mode("append").partitionBy("action_id").parquet(path)


def replace_outcomes(outcomes: DataFrame, path: str) -> None:
    """Write audit rows so that a repeated run replaces its own action's folder."""
    (outcomes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("action_id").parquet(path))


def insert_if_absent(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose key is not stored yet and return exactly those.

    Rows repeated within ``rows`` are inserted once. The new rows are staged before the append, so
    the table that is read is not the one being written to.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(list(keys))
    if path_exists(spark, path):
        # First narrow the stored keys down to those asked for: with few new rows the stored table
        # is scanned once and not shuffled.
        stored = spark.read.parquet(path).select(*keys)
        stored = stored.join(fresh.select(*keys), list(keys), "left_semi")
        fresh = fresh.join(stored, list(keys), "left_anti")
    fresh = stage(fresh.select(*rows.columns), "insert")
    fresh.write.mode("append").parquet(path)
    return fresh


def write_version(df: DataFrame, root: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write a table version to its own folder; readers see it once it is complete."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Highest completely written version below ``root``."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath(root)):
        return None
    versions = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(jpath(root))
                if s.getPath().getName().startswith("version=")
                and fs.exists(jpath(s.getPath(), "_SUCCESS"))]
    return max(versions, default=None)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = latest_version(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no complete version below {root}")
    return spark.read.parquet(f"{root}/version={version}")


def overwrite_account(account_rows: DataFrame, path: str, account_column: str,
                      account_id: Any) -> None:
    """Replace one account's partition of an account-partitioned table.

    The rows come from reading the same table, so they are staged before anything is overwritten;
    other accounts' files are not touched. When no row is left, the partition is removed.
    """
    staged = stage(account_rows, "writeback")
    if not staged.isEmpty():
        (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(account_column).parquet(path))
        return
    spark = account_rows.sparkSession
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    mine = spark.read.parquet(path).where(F.col(account_column) == F.lit(account_id))
    for row in mine.select(folder.alias("folder")).distinct().collect():   # one folder
        if f"/{account_column}=" not in row.folder:
            raise ValueError(f"{path} is not partitioned by {account_column}")
        uri = spark._jvm.java.net.URI(row.folder)
        target = spark._jvm.org.apache.hadoop.fs.Path(uri)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def submission_row(spark: SparkSession, entity: EntitySpec, spec: ActionSpec, batch_size: int,
                   created_at: Any, extra: Mapping[str, Any] | None = None) -> DataFrame:
    """Control row of one submitted action, with its request as JSON."""
    values = {"action_id": spec.action_id, "account_id": spec.account,
              "entity_type": entity.name, "action_type": spec.action,
              "configuration": spec.payload_json(), "batch_size": batch_size, **(extra or {})}
    return spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in values.items()],
        F.lit(created_at).cast("timestamp").alias("created_at"))


def append_submissions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
