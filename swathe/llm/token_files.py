"""Token ids as Arrow files of equal-length sequences, and random access to them.

Layout of a folder written by :func:`write_token_files`:

* ``tokens-<shard>-<attempt>.arrow``: Arrow IPC files. Every record batch holds ``ROWS`` sequences
  (the last of a file may hold fewer): ``ids``, a fixed-size list of unsigned 16- or 32-bit ids,
  and ``mask``, a fixed-size list of booleans that is false where the file's last sequence is
  padded. Buffers are not compressed, so a reader that maps the file uses them in place.
* the index, a Parquet table with a row per document: shard, file, position in the shard, ids.

Shards are ranges of the key in ascending order, and documents follow each other without gaps in
a shard. Only one row per shard meets in one place, to turn positions in a shard into global ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathe.llm.tasks import filesystem, seekable, slices, texts_of
from swathe.llm.tokens import VOCABULARY, library_table
from swathe.sources.staging import stage, staging_path

ROWS = 64


class SequenceFile:
    """Appends ids to one Arrow file, cutting them into sequences of equal length."""

    def __init__(self, uri: str, length: int, dtype: np.dtype):
        files, path = filesystem(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.length, self.dtype = length, dtype
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(dtype), length),
                                 "mask": pa.list_(pa.bool_(), length)})
        self.sink = files.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.written += len(ids)
        if self.held >= ROWS * self.length:
            self.flush(ROWS * self.length)

    def flush(self, step: int) -> None:
        """Write all whole batches of ``step`` ids; what is left over waits."""
        data = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        whole = len(data) // step * step
        for begin in range(0, whole, step):
            self.batch(data[begin:begin + step], step)
        self.waiting, self.held = [data[whole:].copy()], len(data) - whole

    def batch(self, ids: np.ndarray, real: int) -> None:
        self.writer.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field(0).type),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real),
                                              type=self.schema.field(1).type)],
            schema=self.schema))

    def close(self) -> None:
        self.flush(ROWS * self.length)
        rest = self.waiting[0]
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[:len(rest)] = rest
            self.batch(padded, len(rest))
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Spans of ids of one file, without reading the rest of it."""

    def __init__(self, uri: str):
        self.uri, self.file = uri, pa.ipc.open_file(seekable(uri))
        self.at, self.ids, self.mask = -1, None, None
        self.size = ROWS * self.file.schema.field("ids").type.list_size

    def load(self, at: int) -> None:
        if at != self.at:
            batch = self.file.get_batch(at)
            self.at, self.ids = at, batch.column("ids").values.to_numpy()
            self.mask = batch.column("mask").values.to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            self.load(start // self.size)
            begin = start % self.size
            part = self.ids[begin:begin + n]
            if not self.mask[begin:begin + len(part)].all() or not len(part):
                raise ValueError(f"{self.uri}: ids {start} to {start + n} are not in the file")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, length: int = 2048, end_id: int = 0,
                      vocabulary: str = VOCABULARY, folder: str | None = None,
                      key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write the files; returns their index.

    Index columns: ``key``, shard, file, shard_start, n_tokens (with the end id), start (ids of
    all documents before this one). Documents follow in ascending order of ``key`` (null first;
    repeated keys in the order of their texts' hashes, every row by itself). A null text is empty
    and gives the end id alone; an empty table gives no file and an empty index. One shuffle, of
    the texts; a task holds one batch of texts and one of ids. A task that runs again writes a
    file of its own, and the index names the files of the attempts that counted.
    """
    spark = docs.sparkSession
    folder = folder or staging_path(spark, "tokens")
    kind = docs.schema[key].dataType.simpleString()
    laid = docs.select(docs[key].alias("key"), docs[text].alias("text"),
                       F.xxhash64(docs[text]).alias("tie"))
    laid = laid.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocabulary)
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex}.arrow"
        out = None
        for batch in slices(batches, "text"):
            out = out or SequenceFile(uri, length, np.dtype(table.dtype))
            ids, counts = table.ids(texts_of(batch.column("text")))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            starts = out.written + ends - counts + np.arange(len(counts))
            out.append(ids)
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([shard] * n, pa.int32()), pa.array([uri] * n),
                 pa.array(starts, pa.int64()), pa.array(counts + 1, pa.int64())],
                ["key", "shard", "file", "shard_start", "n_tokens"])
        if out:
            out.close()

    index = stage(laid.select("key", "text").mapInArrow(
        write, f"key {kind}, shard int, file string, shard_start long, n_tokens long"),
        "token-index")
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("_size"))
    # One row per shard.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"))
    return (index.join(bases, "shard")
            .withColumn("start", F.col("_base") + F.col("shard_start")).drop("_base")
            .withColumnRenamed("key", key))


def read_token_files(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids (unsigned 32-bit little-endian) of the index's documents,
    read from the files by position. Any selection of index rows may be passed."""
    kind = index.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch, blobs = whole.slice(begin, 256), []
                for uri, start, n in zip(*(batch.column(c).to_pylist() for c in
                                           ("file", "shard_start", "n_tokens"))):
                    if reader is None or reader.uri != uri:
                        reader = SequenceReader(uri)
                    blobs.append(reader.span(start, n).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("start"), batch.column("n_tokens"),
                     pa.array(blobs, pa.binary())], ["key", "start", "n_tokens", "ids"])

    return index.select(F.col(key).alias("key"), "start", "n_tokens", "file", "shard_start"
                        ).mapInArrow(read, f"key {kind}, start long, n_tokens long, ids binary"
                                     ).withColumnRenamed("key", key)
