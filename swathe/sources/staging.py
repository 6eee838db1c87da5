"""Intermediate tables on shared storage.

A step that more than one result depends on, or whose layout later steps rely on, is written once
as Parquet and read back. That cuts lineage (a lost executor re-reads files instead of recomputing
the upstream plan), keeps column pruning, and fixes the row layout for good.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would not be visible to the other executors, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="swathe-"))
            current = spark.sparkContext.getCheckpointDir()
        return current.rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the staging folder."""
    return f"{staging_root(spark)}/swathe/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame reading it back."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the staged files behind the given DataFrames (only files below the staging root)."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        marker = "/swathe/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if marker in folder and staging_root(spark).split(":")[-1] in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
