"""Keyed state that grows with its keys, not with the triggers that wrote it.

Every trigger writes its rows as a run, cut into buckets by the hash of the key. A reader asks for some
keys: it opens the buckets of these, in every run, and the newest row of a key counts. Runs are merged
``fan`` at a time into one of the next level, so their number grows with the logarithm of the triggers,
and a row is written again as often as that.

A trigger that is delivered again overwrites its run and looks at earlier ones only. Merging leaves the
newest run alone, as its trigger may come again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedState:
    """Rows by key below ``root``; ``version`` names the column that holds a row's trigger."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 16,
                 fan: int = 8, version: str = "version"):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.buckets, self.fan, self.version = buckets, fan, version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folder(self, first: int, last: int) -> str:
        return f"{self.root}/run={first:010d}-{last:010d}"

    def _complete(self, before: int | None) -> list[tuple[int, int, bool]]:
        """First and last trigger of complete runs, and whether they hold rows."""
        if not self._files.exists(self._path(self.root)):
            return []
        found = []
        for status in self._files.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("run="):
                inside = {s.getPath().getName() for s in self._files.listStatus(status.getPath())}
                first, last = map(int, name[4:].split("-"))
                if "_SUCCESS" in inside and (before is None or last < before):
                    found.append((first, last, any(n.startswith("bucket=") for n in inside)))
        return found

    def runs(self, before: int | None = None) -> list[tuple[int, int]]:
        """Runs (first and last trigger) that hold rows and end before a trigger, oldest first; of
        a merged run and its parts only the merged one."""
        found = [(first, last) for first, last, filled in self._complete(before) if filled]
        kept: list[tuple[int, int]] = []
        for first, last in sorted(found, key=lambda r: r[0] - r[1]):
            if not any(a <= first and last <= b for a, b in kept):
                kept.append((first, last))
        return sorted(kept)

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return (self.spark.read.option("basePath", self.root)
                .parquet(*[self._folder(*r) for r in runs]).drop("run"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, "bucket")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.version).alias("_row"))
        return newest.select(*self.keys, "_row.*")

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest row of every key, None if there are no runs."""
        runs = self.runs(before)
        return self._newest(self._read(runs)) if runs else None

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame | None:
        """The newest row of the keys in ``wanted``. Only their buckets are opened."""
        runs = self.runs(before)
        if not runs:
            return None
        keys = wanted.select(*self.keys).distinct()
        touched = [r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        rows = self._read(runs).where(F.col("bucket").isin(touched)) if touched else (
            self._read(runs).where("false"))
        return self._newest(rows.join(keys, self.keys, "left_semi"))

    def write(self, trigger: int, rows: DataFrame) -> None:
        """The run of a trigger; a second delivery replaces it."""
        (rows.withColumns({self.version: F.lit(trigger).cast("long"), "bucket": self._bucket()})
         .repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(self._folder(trigger, trigger)))

    def _level(self, run: tuple[int, int]) -> int:
        triggers, level = run[1] - run[0] + 1, 0
        while triggers >= self.fan:
            triggers, level = triggers // self.fan, level + 1
        return level

    def compact(self, before: int) -> int:
        """Merge runs that end before a trigger, while ``fan`` neighbours of a level are there;
        returns how many merges that took. The parts are removed when the merged run is complete,
        runs without rows at once."""
        for first, last, filled in self._complete(before):
            if not filled:
                self._files.delete(self._path(self._folder(first, last)), True)
        merges = 0
        while True:
            runs = self.runs(before)
            for i in range(len(runs) - self.fan + 1):
                group = runs[i:i + self.fan]
                if len({self._level(r) for r in group}) == 1:
                    break
            else:
                return merges
            merged = self._newest(self._read(group)).withColumn("bucket", self._bucket())
            (merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
             .parquet(self._folder(group[0][0], group[-1][1])))
            for run in group:
                self._files.delete(self._path(self._folder(*run)), True)
            merges += 1
