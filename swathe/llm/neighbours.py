"""Approximate nearest neighbours by learned partitions of a neighbour graph.

On a bounded sample the exact neighbour graph is cut into balanced partitions with few edges
between them. A small softmax classifier learns to tell a vector's partition, from soft targets:
the shares of the partitions among the vector's graph neighbours. Every vector is filed under its
most probable partition; a query goes to the several most probable ones and all vectors there are
compared exactly. The sample rows among them already tell how good a result must be at least, so
blocks return only rows that reach it.

Vectors and queries of a partition meet in blocks of bounded size, whatever a partition holds, so
a third of all vectors may be copies of one. Nearest rows of the blocks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.sources.staging import stage

SAMPLE = 8_192          # rows that partitions and classifier are fitted on, at most
PER_PARTITION = 2_048   # rows that a partition is meant to hold
MOST_PARTITIONS = 256
LEAST_PARTITIONS = 4    # of a table with enough different rows
VECTORS, QUERIES = 4_096, 1_024  # rows of a block


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product for every row of the sample, block by block."""
    out = np.empty((len(x), k), np.int64)
    for begin in range(0, len(x), 1024):
        scores = x[begin:begin + 1024] @ x.T
        scores[np.arange(len(scores)), begin + np.arange(len(scores))] = -np.inf
        out[begin:begin + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12,
                   seed: int = 5) -> np.ndarray:
    """Partition of the graph's nodes: parts of nearly equal size, neighbours together.

    Starts from equal slices along a random tree of directions, then moves nodes to the part of
    most of their neighbours, best gains first, as long as sizes stay within a tenth of the mean.
    """
    draw = np.random.default_rng(seed)
    label = np.zeros(len(x), np.int64)
    pieces = [(np.arange(len(x)), 0, parts)]
    while pieces:
        rows, first, n = pieces.pop()
        if n == 1:
            label[rows] = first
            continue
        own = x[rows] - x[rows].mean(axis=0)
        direction = draw.standard_normal(x.shape[1])
        for _ in range(5):  # power steps: the direction in which the rows differ most
            direction = own.T @ (own @ direction)
            direction /= np.linalg.norm(direction) + 1e-30
        ordered = rows[np.argsort(own @ direction, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        pieces += [(ordered[:cut], first, left), (ordered[cut:], first + left, n - left)]
    mean = len(x) / parts
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        gain = votes - votes[np.arange(len(x)), label][:, None]
        target = gain.argmax(axis=1)
        best = gain[np.arange(len(x)), target]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-best, kind="stable").tolist():
            if best[i] <= 0:
                break
            a, b = label[i], target[i]
            if sizes[b] < 1.1 * mean + 1 and sizes[a] > 0.9 * mean - 1:
                label[i] = b
                sizes[a] -= 1
                sizes[b] += 1
                moved += 1
        if moved < len(x) / 500:
            break
    return label


def fit_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int,
               epochs: int = 60, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of the softmax classifier, by mini-batch steps with momentum."""
    draw = np.random.default_rng(seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
    target[np.arange(len(x)), label] += 1
    target /= target.sum(axis=1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    mw, mb, vw, vb, t = np.zeros_like(w), np.zeros_like(b), np.zeros_like(w), np.zeros_like(b), 0
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(len(x)), max(1, len(x) // 256)):
            z = x[rows] @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - target[rows]) / len(rows)
            t += 1
            for value, grad, m, v in ((w, x[rows].T @ d, mw, vw), (b, d.sum(axis=0), mb, vb)):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w, b


def probes_for(x: np.ndarray, held: np.ndarray, w: np.ndarray, b: np.ndarray, k: int,
               recall: float) -> int:
    """Fewest partitions that hold ``recall`` of the k nearest sample rows of the held-out rows."""
    scores = x[held] @ x.T
    scores[np.arange(len(held)), held] = -np.inf
    k = min(k, len(x) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    part = (x @ w + b).argmax(axis=1)
    place = np.argsort(np.argsort(-(x[held] @ w + b), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, part[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1


def least_scores(queries: np.ndarray, visited: np.ndarray, x: np.ndarray, part: np.ndarray,
                 k: int) -> np.ndarray:
    """Per query the k-th largest score of the sample rows in the partitions that it visits.

    These rows are candidates, so no result scores less; -inf where there are fewer than k.
    """
    out = np.full(len(queries), -np.inf)
    if len(x) >= k:
        for begin in range(0, len(queries), 256):
            scores = queries[begin:begin + 256] @ x.T
            scores[~visited[begin:begin + 256][:, part]] = -np.inf
            out[begin:begin + 256] = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
    return out


def usable(column: str, width: int):
    """Vectors that take part: as long as the others, all components finite, not all zero."""
    finite = f"forall({column}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf'))"
    return F.expr(f"size({column}) = {width} AND coalesce({finite}, false) "
                  f"AND exists({column}, v -> v <> 0)")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95,
            sample: int = SAMPLE, least_parts: int = LEAST_PARTITIONS, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), ``key``, score of the ``k`` found candidates of largest inner
    product per query; ties go to the smaller key. A query's own key is no candidate.

    Scores are exact inner products in double precision. A query is sent to its most probable
    partitions: as many as held ``recall`` of the nearest rows of a fifth of the sample that the
    classifier was not fitted on, and more until they hold k candidates besides the query's own
    rows, so only a table of fewer rows gives fewer than ``k``. Vectors that are null, zero, of
    another length than most or hold null or non-finite components take no part; neither do null
    keys. Repeated keys are candidates of their own, repeated queries have one answer. Other
    columns are not read; empty tables give no rows.

    Small tables are cut into ``least_parts`` partitions, unless there are fewer than 32 different
    rows for each. Fitted on at most ``sample`` rows, chosen by hash; the index holds every row. The driver holds
    the sample, the classifier and one count per partition.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    columns = [F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")]
    widths = (vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("w")).count()
              .orderBy(F.desc("count"), "w").first())
    schema = f"query_id {kind}, rank int, {key} {kind}, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths["w"]
    rows = vectors.select(*columns).where(F.col("key").isNotNull() & usable("v", width))
    asked = queries.select(*columns).where(F.col("key").isNotNull() & usable("v", width))

    chosen = rows.orderBy(F.xxhash64("key", "v"), "key").limit(sample).select("v").collect()
    total = rows.count()
    if not chosen:
        return spark.createDataFrame([], schema)
    x = np.unique(np.array([r["v"] for r in chosen]), axis=0)  # copies would only crowd the graph
    norm = float(np.linalg.norm(x, axis=1).mean())
    parts = int(min(MOST_PARTITIONS, max(least_parts, total // PER_PARTITION),
                    max(1, len(x) // 32)))
    if parts > 1:
        held_out = np.arange(len(x)) % 5 == 0  # x is in order of value, so this is no draw of copies
        fitted = x[~held_out]
        graph = neighbour_graph(fitted, min(10, len(fitted) - 1))
        label = balanced_parts(fitted, graph, parts)
        w, b = fit_router(fitted / norm, graph, label, parts)
        probes = probes_for(x / norm, np.flatnonzero(held_out), w, b, k, recall)
    else:
        w, b, probes = np.zeros((width, 1)), np.zeros(1), 1
    router = spark.sparkContext.broadcast((w / norm, b))
    known = spark.sparkContext.broadcast((x, (x @ w / norm + b).argmax(axis=1)))

    def file_under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offsets = router.value
        for batch in batches:
            if batch.num_rows:
                best = (matrix(batch.column("v"), width) @ weights + offsets).argmax(axis=1)
                # Staged with the rows, so a row stays in its block if a task runs again.
                draw = np.random.default_rng().integers(0, 1 << 30, len(best), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("v"), pa.array(best.astype(np.int32)),
                     pa.array(draw)], ["key", "v", "part", "draw"])

    filed = stage(rows.mapInArrow(
        file_under, f"key {kind}, v array<double>, part int, draw int"), "filed")
    held = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}
    sizes = np.array([held.get(p, 0) for p in range(parts)])
    repeats = filed.groupBy("key").count().agg(F.max("count")).first()[0]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offsets = router.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(matrix(batch.column("v"), width) @ weights + offsets), axis=1,
                               kind="stable")
            reached = np.cumsum(sizes[order], axis=1)
            before = reached - sizes[order]
            goes = (np.arange(parts) < probes) | (before < k + repeats)
            query, place = np.nonzero(goes & (sizes[order] > 0))
            visited = np.zeros((len(order), parts), bool)
            visited[query, order[query, place]] = True
            bound = least_scores(matrix(batch.column("v"), width), visited, *known.value,
                                 k + repeats)
            taken = batch.take(pa.array(query))
            yield pa.RecordBatch.from_arrays(
                [taken.column("key"), taken.column("v"),
                 pa.array(order[query, place].astype(np.int32)), pa.array(bound[query])],
                ["key", "v", "part", "bound"])

    routed = stage(asked.mapInArrow(
        route, f"key {kind}, v array<double>, part int, bound double"), "routed")
    sent = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}

    def blocks(counts: list[int], size: int):
        numbers = [max(1, -(-n // size)) for n in counts]
        return F.element_at(F.array(*map(F.lit, numbers)), F.col("part") + 1)

    def every(number) -> Column:
        return F.explode(F.sequence(F.lit(0), number - 1))

    v_blocks = blocks(sizes.tolist(), VECTORS)
    q_blocks = blocks([sent.get(p, 0) for p in range(parts)], QUERIES)
    stored = filed.select("part", "key", "v", F.pmod("draw", v_blocks).alias("v_block"),
                          every(q_blocks).alias("q_block"))
    sought = routed.select("part", "key", "v", "bound", F.pmod(F.xxhash64("key", "v"), q_blocks)
                           .cast("int").alias("q_block"), every(v_blocks).alias("v_block"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], left.schema.field("key").type),
                          "key": pa.array([], left.schema.field("key").type),
                          "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        lv = matrix(left.column("v").combine_chunks(), width)
        rv = matrix(right.column("v").combine_chunks(), width)
        lk, rk = (np.array(t.column("key").to_pylist()) for t in (left, right))
        bounds = right.column("bound").to_numpy()
        queries_of, keys, scores = [], [], []
        for begin in range(0, len(rv), 256):
            product = rv[begin:begin + 256] @ lv.T
            for q, row, bound, s in zip(*(c[begin:begin + 256] for c in (rk, rv, bounds)),
                                        product):
                s[lk == q] = -np.inf
                n = min(k, len(s))
                least = max(bound, np.partition(s, len(s) - n)[len(s) - n])
                at = np.flatnonzero((s >= least - 1e-9 * (1 + abs(least))) & (s > -np.inf))
                # The same sum for every row, so that copies tie exactly.
                exact = (lv[at] * row).sum(axis=1)
                order = np.lexsort((lk[at], -exact))[:n]
                queries_of.append(np.repeat(q, len(order)))
                keys.append(lk[at][order])
                scores.append(exact[order])
        return pa.table({"query_id": np.concatenate(queries_of), "key": np.concatenate(keys),
                         "score": np.concatenate(scores)}, schema=empty.schema)

    by = ["part", "v_block", "q_block"]
    found = stored.groupBy(*by).cogroup(sought.groupBy(*by)).applyInArrow(
        compare, f"query_id {kind}, key {kind}, score double")
    # Repeated query rows find the same candidates again: one answer per query key.
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return (found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("key").alias(key), "score"))
