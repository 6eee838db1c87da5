"""A table and its control tables in one place, changed by commits.

A store is a folder of Parquet files that are never changed, and a log of numbered commits. A commit
names the files that make up the table from then on (its manifest) and the control rows that came with
it; it becomes visible by creating one file under the next free number, which only one writer can do.
So a job that dies leaves nothing that readers see, and of two writers that start from the same
version one wins and the other starts again from the winner's.

A change rewrites only the files that hold a changed row (copy on write). Untouched files belong to
the old version and the new one alike, and old versions stay readable until :meth:`Store.vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathe.model import ConflictError


def _file(path: str = "_path") -> Column:
    """The file at ``path`` as manifests name it. For one row per file: rows carry the plain path,
    as taking a name out of it costs more than reading a row."""
    return F.regexp_extract(F.url_decode(path), r"([^/]+/[^/]+)$", 1)


def _path() -> Column:
    """The path of the file that a row of a store's table stands in."""
    return F.col("_metadata.file_path").alias("_path")


@dataclass(frozen=True)
class Commit:
    """One entry of the log: the table's manifest and schema, and folders of control rows by name."""

    number: int
    manifest: str
    schema: str
    parts: Mapping[str, str]
    note: Mapping[str, Any]


class Log:
    """Numbered entries below a folder; an entry is created once and by one writer."""

    def __init__(self, spark: SparkSession, root: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._jvm, self._gateway, self._root = spark._jvm, spark.sparkContext._gateway, root
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self._root}/{name}" if name else self._root)

    def newest(self) -> int:
        """Number of the newest entry, 0 if there is none."""
        folder = self._path("")
        if not self._files.exists(folder):
            return 0
        return max((int(n) for s in self._files.listStatus(folder)
                    if (n := s.getPath().getName()).isdigit()), default=0)

    def read(self, number: int) -> Any:
        stream = self._files.open(self._path(f"{number:020d}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def append(self, number: int, entry: Any) -> bool:
        """Create the entry; False if another writer has. The content is complete before the
        entry has its name, and the renaming fails where the name is taken."""
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"{number:020d}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        rename = getattr(self._hadoop, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self._conf)
        try:
            context.rename(draft, final, options)
        except Exception:
            if not self._files.exists(final):
                raise
            self._files.delete(draft, False)
            return False
        return True


class Store:
    """A versioned table with control tables below ``root`` (shared storage)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, f"{self.root}/log")

    # --- reading ----------------------------------------------------------------------------

    def version(self) -> int:
        return self.log.newest()

    def commit_at(self, version: int | None = None) -> Commit:
        number = self.version() if version is None else version
        if not number:
            raise FileNotFoundError(f"no version below {self.root}")
        return Commit(number, **self.log.read(number))

    def manifest(self, version: int | None = None) -> DataFrame:
        """(file, bytes, rows) of a version."""
        return self.spark.read.schema("file string, bytes long, rows long").parquet(
            f"{self.root}/manifests/{self.commit_at(version).manifest}")

    def table(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest by default."""
        commit = self.commit_at(version)
        return self._read([r["file"] for r in self.manifest(commit.number).toLocalIterator()],
                          T.StructType.fromJson(json.loads(commit.schema)))

    def _read(self, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/files/{f}" for f in files])

    def rows(self, name: str, version: int | None = None, **note: Any) -> DataFrame | None:
        """Control rows of all commits up to a version (whose notes have the given values)."""
        newest = self.version() if version is None else version
        found = [c.parts[name] for c in map(self.commit_at, range(1, newest + 1))
                 if name in c.parts and all(c.note.get(k) == v for k, v in note.items())]
        if not found:
            return None
        return self.spark.read.parquet(*[f"{self.root}/rows/{f}" for f in found])

    # --- writing ----------------------------------------------------------------------------

    def create(self, table: DataFrame) -> int:
        """Version 1 from a table."""
        files = self._write_files(table)
        if not self._commit(1, files, table.schema, {}, {}):
            raise ConflictError(f"{self.root} has a table already")
        return 1

    def touched(self, rows: DataFrame) -> list[str]:
        """Files that hold some of ``rows``, a selection from :meth:`table`."""
        return [r["file"] for r in rows.select(_path()).distinct().select(
            _file().alias("file")).toLocalIterator()]

    def change(self, chosen: Column | DataFrame, new_rows: Callable[[DataFrame], DataFrame],
               parts: Mapping[str, DataFrame] | None = None, note: Mapping[str, Any] | None = None,
               base: int | None = None) -> int | None:
        """Commit a new version in which the files with a ``chosen`` row are rewritten.

        ``chosen`` is a predicate or a table of keys (one column of the table's); ``new_rows``
        turns the rows of these files into what replaces them. ``parts`` are control rows that
        become visible with the version. Returns its number, or None if another writer has
        committed on top of ``base`` in the meantime: nothing is visible then.
        """
        commit = self.commit_at(base)
        table = self.table(commit.number)
        if isinstance(chosen, Column):
            files = self.touched(table.where(chosen))
        else:
            keys = table.select(*chosen.columns, _path())
            hit = keys.join(chosen, chosen.columns, "left_semi").select("_path").distinct()
            files = [r["file"] for r in hit.select(_file().alias("file")).toLocalIterator()]
        manifest = self.manifest(commit.number)
        if files:
            old = self._read(files, table.schema).select("*", _path())
            # One file for each that is replaced, in the order its rows had been laid out.
            new = new_rows(old).repartition(len(files), "_path").drop("_path")
            gone = self.spark.createDataFrame([(f,) for f in files], "file string")
            manifest = manifest.join(gone, "file", "left_anti").unionByName(self._write_files(new))
        if self._commit(commit.number + 1, manifest, table.schema, parts or {}, note or {}):
            return commit.number + 1
        return None

    def add_rows(self, parts: Mapping[str, DataFrame], note: Mapping[str, Any] | None = None,
                 base: int | None = None) -> int | None:
        """Commit control rows alone; the table stays as it is."""
        commit = self.commit_at(base)
        entry = {"manifest": commit.manifest, "schema": commit.schema,
                 "parts": self._write_rows(parts), "note": dict(note or {})}
        return commit.number + 1 if self.log.append(commit.number + 1, entry) else None

    def _write_files(self, rows: DataFrame) -> DataFrame:
        """Write rows as new files; (file, bytes, rows) of these."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/files/{folder}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.root}/files/{folder}")
        counted = written.groupBy(_path(), F.col("_metadata.file_size").alias("bytes")).agg(
            F.count("*").alias("rows"))
        return counted.select(_file().alias("file"), "bytes", "rows").where("rows > 0")

    def _write_rows(self, parts: Mapping[str, DataFrame]) -> dict[str, str]:
        folders = {name: f"{name}-{uuid.uuid4().hex}" for name in parts}
        for name, rows in parts.items():
            rows.write.parquet(f"{self.root}/rows/{folders[name]}")
        return folders

    def _commit(self, number: int, manifest: DataFrame, schema: T.StructType,
                parts: Mapping[str, DataFrame], note: Mapping[str, Any]) -> bool:
        name = uuid.uuid4().hex
        manifest.select("file", "bytes", "rows").coalesce(1).write.parquet(
            f"{self.root}/manifests/{name}")
        return self.log.append(number, {
            "manifest": name, "schema": schema.json(), "parts": self._write_rows(parts),
            "note": dict(note)})

    def vacuum(self, keep: int) -> list[str]:
        """Delete the files that none of the newest ``keep`` versions has but an older one had;
        those older versions can no longer be read. Returns what was deleted."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        older = range(1, kept.start)
        if not older:
            return []

        def files(versions: range) -> DataFrame:
            return reduce(DataFrame.unionByName, (self.manifest(v) for v in versions)).select(
                "file").distinct()

        doomed = [r["file"] for r in files(older).join(files(kept), "file", "left_anti")
                  .toLocalIterator()]
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for file in doomed:
            path = hadoop.Path(f"{self.root}/files/{file}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)
        return doomed


def insert_if_absent(store: Store, name: str, rows: DataFrame, keys: list[str],
                     tries: int = 20) -> DataFrame:
    """Add the ``rows`` whose key no control row ``name`` holds yet, and return exactly those.

    Safe with several writers: a writer that another one overtakes looks at what that one added and
    tries again, so a key is won once. Rows repeated within ``rows`` count once (the smallest).
    """
    order = [c for c in rows.columns if c not in keys]
    first = F.min(F.struct(*order)) if order else F.lit(None)
    fresh = rows.groupBy(*keys).agg(first.alias("_row")).select(
        *keys, *([F.col(f"_row.{c}").alias(c) for c in order])).select(*rows.columns)
    for _ in range(tries):
        base = store.version()
        held = store.rows(name, base)
        if held is None:
            mine = fresh
        else:
            asked = held.select(*keys).join(fresh.select(*keys), keys, "left_semi")
            mine = fresh.join(asked, keys, "left_anti")
        number = store.add_rows({name: mine.select(*rows.columns)}, {"insert": name}, base)
        if number is not None:
            return store.spark.read.schema(rows.schema).parquet(
                f"{store.root}/rows/{store.commit_at(number).parts[name]}")
    raise ConflictError(f"{tries} other writers came first")
