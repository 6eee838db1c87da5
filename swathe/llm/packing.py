"""Packing of token ids into fixed-length sequences: first-fit decreasing in random groups.

Documents are dealt evenly over the partitions and put in hash order there; every ``group_docs``
documents in a row form a group. A document's whole sequences stand alone; the rests of a group
are placed by decreasing length, each into the first sequence with room. A tournament tree over
the sequences' free places finds that one in O(log n). A group holds less than
``group_docs * length`` ids, whatever the sizes of documents are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.llm.tasks import slices, texts_of
from swathe.llm.tokens import VOCABULARY, library_table

_SEQUENCE_BITS = 33


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every item; bins are numbered from 0. Equal sizes keep their order."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    free = [capacity] * (2 * leaves)  # free[i] is the larger of free[2i] and free[2i + 1]
    placed = [(0, 0)] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        placed[item] = (node - leaves, capacity - free[node])
        free[node] -= size
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return placed


def pack_documents(docs: DataFrame, length: int = 2048, end_id: int = 1, group_docs: int = 2048,
                   seed: int = 17, vocabulary: str = VOCABULARY, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """A row per piece: ``key``, start, length, doc_tokens, sequence_id, offset, ids.

    A document's ids are those of its whole text plus ``end_id``; a null or empty text is the end
    id alone. ``ids`` holds the piece's ids (unsigned 32-bit, little-endian), start the ids of its
    document before it, offset its place in sequence ``sequence_id``. Pieces fill a sequence from
    0 without gaps; the rest is padding. Null and repeated keys are packed like any other row;
    other columns are not read; an empty table gives no pieces. One shuffle, of the texts. Rows
    are dealt round robin, so no key or source can crowd a task, and sorted, so that a task that
    runs again packs the same groups.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(docs[key].alias("key"), docs[text].alias("text"),
                        F.xxhash64(F.lit(seed), docs[key], docs[text]).alias("draw"))
    dealt = dealt.repartition(parts).sortWithinPartitions("draw", "key", "text")
    names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocabulary)
        sequence = TaskContext.get().partitionId() << _SEQUENCE_BITS
        rests: list[tuple] = []  # (key, start, document's ids in all, ids)

        def rows(pieces: list[tuple], keys: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], keys)] + [pa.array(c, pa.int64()) for c in columns[1:6]]
                + [pa.array(columns[6], pa.binary())], names)

        def close_group() -> list[tuple]:
            nonlocal sequence
            placed = first_fit_decreasing([len(r[3]) for r in rests], length)
            pieces = [(k, start, len(ids), total, sequence + b, at, ids.astype("<u4").tobytes())
                      for (k, start, total, ids), (b, at) in zip(rests, placed)]
            sequence += 1 + max((b for b, _ in placed), default=-1)
            rests.clear()
            return pieces

        kinds = None
        for batch in slices(batches, "text"):
            kinds = batch.schema.field("key").type
            ids, counts = table.ids(texts_of(batch.column("text")))
            pieces, at = [], 0
            for k, n in zip(batch.column("key").to_pylist(), counts.tolist()):
                own = np.append(ids[at:at + n], ids.dtype.type(end_id))
                at, total = at + n, n + 1
                for start in range(0, total - length + 1, length):
                    pieces.append((k, start, length, total, sequence, 0,
                                   own[start:start + length].astype("<u4").tobytes()))
                    sequence += 1
                if total % length:
                    start = total - total % length
                    rests.append((k, start, total, own[start:].copy()))
                    if len(rests) >= group_docs:
                        pieces += close_group()
            if pieces:
                yield rows(pieces, kinds)
        if rests:
            yield rows(close_group(), kinds)

    return dealt.select("key", "text").mapInArrow(
        pack, f"key {kind}, start long, length long, doc_tokens long, sequence_id long, "
              "offset long, ids binary").withColumnRenamed("key", key)
