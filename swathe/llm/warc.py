"""WARC archives: writing, normalising whole-file gzip streams, and random access by an index.

:func:`write_archives` writes one archive per task as a single gzip stream, the form in which many
archives arrive. :func:`normalise_archives` inflates such a stream once, from front to back,
rewrites every record as a gzip member of its own and writes a sidecar index of offsets, after
which :func:`read_records` reads any record by itself. Files live on shared storage; a task that
runs again writes files of its own, and the returned tables name those that count.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.llm.tasks import filesystem, seekable, slices
from swathe.sources.staging import stage, staging_path

CHUNK = 1 << 18
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def record_id(key) -> str:
    return f"<urn:record:{'' if key is None else quote(str(key), safe='')}>"


def record_bytes(key, url: str | None, payload: bytes, digest: str, first, revisit: bool,
                 date: str) -> bytes:
    """One WARC record. A revisit has the HTTP header but no payload."""
    body = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}"]
    if url:
        target = _BREAKS.sub(lambda m: quote(m[0]), url)
        head.append(f"WARC-Target-URI: {target}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def first_records(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` (key, url, payload) with digest and, for records that repeat a payload of at least
    ``least`` bytes, the smallest key that has it (``first``), else null.

    The smallest key of a payload is a map-side combined minimum; only digests that occur more
    than once are joined back, so a payload that a third of all rows share is one row there and
    Spark splits its side of the join.
    """
    marked = pages.withColumn("digest", F.sha2(F.coalesce("payload", F.lit("")), 256))
    large = F.octet_length("payload") >= least
    groups = (marked.where(large).groupBy("digest")
              .agg(F.min("key").alias("first"), F.count("*").alias("n"))
              .where("n > 1").select(F.col("digest").alias("_digest"), "first"))
    joined = marked.join(groups, large & (F.col("digest") == F.col("_digest")), "left")
    repeats = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return joined.select("key", "url", "payload", "digest",
                         F.when(repeats, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, least: int = 100, level: int = 6,
                   date: str = "2024-01-01T00:00:00Z", folder: str | None = None,
                   key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record per row and return (archive, records), a row per archive.

    Of equal payloads of at least ``least`` bytes the row with the smallest key is a response and
    the others revisit it; shorter payloads are all responses. Rows that repeat the smallest key
    are responses too. A null payload is empty, a null url has no target header, null keys never
    are the smallest; other columns are not read. Empty tables give no archives. An archive holds
    what one task reads, one record in memory at a time.
    """
    spark = pages.sparkSession
    folder = folder or staging_path(spark, "warc")
    rows = first_records(pages.select(pages[key].alias("key"), pages[url].alias("url"),
                                      pages[payload].alias("payload")), least)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        sink, n = None, 0
        for batch in slices(batches, "payload"):
            if sink is None:
                files, path = filesystem(uri)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                sink = files.open_output_stream(path, compression=None)
                packer = zlib.compressobj(level, 8, 31)
            for k, u, p, d, f in zip(*(batch.column(c).to_pylist() for c in (
                    "key", "url", "payload", "digest", "first"))):
                sink.write(packer.compress(record_bytes(
                    k, u, (p or "").encode(), d, f, f is not None, date)))
                n += 1
        if sink is not None:
            sink.write(packer.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [uri], "records": pa.array([n])})

    return stage(rows.mapInArrow(write, "archive string, records long"), "archives")


class Inflated:
    """Front-to-back reading of a gzip file of one or many members."""

    def __init__(self, source):
        self.source, self.inflate, self.buffer = source, zlib.decompressobj(31), b""
        self.ended = False

    def more(self) -> bool:
        """Add decompressed bytes to the buffer; false at the end of the file."""
        while not self.ended:
            raw = self.inflate.unconsumed_tail or (
                self.inflate.unused_data if self.inflate.eof else b"") or self.source.read(CHUNK)
            if self.inflate.eof:
                if not raw:
                    self.ended = True
                    break
                self.inflate = zlib.decompressobj(31)
            new = self.inflate.decompress(raw, CHUNK)  # the rest of raw is its unconsumed_tail
            if not new and not raw and not self.inflate.eof:
                raise ValueError("the gzip stream breaks off")
            if new:
                self.buffer += new
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                if self.buffer:
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.buffer = self.buffer[:at + len(mark)], self.buffer[at + len(mark):]
        return out

    def chunks(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, piece by piece."""
        while size:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.buffer = self.buffer[:size], self.buffer[size:]
            size -= len(part)
            yield part


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip()
            for name, _, value in (line.partition(":") for line in lines[1:] if line)}


def normalise_archives(archives: DataFrame, level: int = 6, folder: str | None = None
                       ) -> DataFrame:
    """Rewrite every archive with a gzip member per record; returns the index.

    Index columns: file, offset, length (of the member), record_id, record_type, target_uri. The
    same rows but for the file name stand in a tab-separated sidecar ``<file>.idx``. A stream is
    inflated once, front to back, and records pass through in pieces, so neither archives nor
    records need fit in memory; one archive is one task, as a gzip stream cannot be entered in the
    middle. Archives that already have members pass through the same way. A damaged archive fails
    the job. No archives give an empty index.
    """
    spark = archives.sparkSession
    folder = folder or staging_path(spark, "warc-members")
    parts = max(1, min(archives.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                name = uri.rpartition("/")[2].partition(".")[0]
                target = f"{folder}/{name}-{uuid.uuid4().hex[:12]}.warc.gz"
                files, path = filesystem(target)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                source_files, source_path = filesystem(uri)
                rows = []
                with (source_files.open_input_stream(source_path, compression=None) as source,
                      files.open_output_stream(path, compression=None) as out,
                      files.open_output_stream(path + ".idx", compression=None) as sidecar):
                    stream = Inflated(source)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        fields = headers_of(head)
                        member, begin = zlib.compressobj(level, 8, 31), out.tell()
                        out.write(member.compress(head))
                        for piece in stream.chunks(int(fields["content-length"]) + 4):
                            out.write(member.compress(piece))
                        out.write(member.flush())
                        length = out.tell() - begin
                        row = (begin, length, fields.get("warc-record-id"),
                               fields.get("warc-type"), fields.get("warc-target-uri"))
                        sidecar.write(("\t".join("" if x is None else str(x) for x in row)
                                       + "\n").encode())
                        rows.append(row)
                        if len(rows) >= 4096:
                            yield index_batch(target, rows)
                            rows = []
                if rows:
                    yield index_batch(target, rows)

    return stage(archives.select("archive").repartition(parts).mapInArrow(
        normalise, "file string, offset long, length long, record_id string, record_type string, "
                   "target_uri string"), "warc-index")


def index_batch(file: str, rows: list[tuple]) -> pa.RecordBatch:
    offset, length, *texts = (list(c) for c in zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(rows)), pa.array(offset, pa.int64()), pa.array(length, pa.int64()),
         *(pa.array(t, pa.string()) for t in texts)],
        ["file", "offset", "length", "record_id", "record_type", "target_uri"])


def read_records(index: DataFrame) -> DataFrame:
    """The index's records, each read by itself: record_id, record_type, target_uri, refers_to,
    payload_digest and payload_bytes as the headers state them, payload (null for revisits)."""
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest",
             "payload_bytes", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                rows = []
                batch = whole.slice(begin, 256)
                for uri, offset, length in zip(*(batch.column(c).to_pylist() for c in (
                        "file", "offset", "length"))):
                    if uri != name:
                        file, name = seekable(uri), uri
                    file.seek(offset)
                    record = zlib.decompress(file.read(length), 31)
                    head, _, body = record.partition(b"\r\n\r\n")
                    fields = headers_of(head)
                    body = body[:int(fields["content-length"])].partition(b"\r\n\r\n")[2]
                    rows.append((
                        fields["warc-record-id"], fields["warc-type"],
                        fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                        fields.get("warc-payload-digest"), int(fields["x-payload-bytes"]),
                        None if fields["warc-type"] == "revisit" else body))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns[:5]),
                     pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.binary())], names)

    return index.select("file", "offset", "length").mapInArrow(
        read, "record_id string, record_type string, target_uri string, refers_to string, "
              "payload_digest string, payload_bytes long, payload binary")
