"""Ranked lexical search: every test item against all documents, by trees of document vectors.

1. One pass over the texts gives lengths, document frequencies, and each document's restricted
   vector: its counts of the terms that occur in some item.
2. Tasks take their vectors in groups. Terms are ordered by falling document frequency, so vectors
   written in that order share beginnings, and the group becomes a frequent-pattern tree: a
   subtree is a run of the sorted vectors with a common path. Every subtree keeps the largest count
   per term and the smallest length norm m. A score falls with m and grows with counts, so the
   score of these extremes bounds every document below.
3. An item's bounds for all subtrees come from one walk over its terms' entries. The item then goes
   depth first, highest bound first, and leaves out subtrees below its tenth score so far, which it
   carries from group to group. Documents that are reached get their exact score.
4. The best of each task are ranked by Spark.

Paths that are not shared are not cut into nodes one by one: a node that holds more than half of
its parent's documents is merged with it, and a leaf holds a run of up to ``_LEAF`` documents.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathe.llm.tasks import slices, texts_of
from swathe.sources.staging import stage

# Fixed: a term is a run of ASCII letters, digits and characters beyond ASCII.
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_GROUP = 8192            # documents in a tree, at most
_ENTRIES = 4_000_000     # entries of vectors in a tree, about
_LEAF = 16
_DOCUMENTS, _TERMS = -1, -2


def terms_of(text: str) -> list[bytes]:
    """The text's terms in order, A-Z in lower case."""
    return text.encode().lower().translate(_BLANK).split()


def restricted_vectors(docs: DataFrame, vocabulary, key_type: str) -> DataFrame:
    """Staged rows of two kinds: vectors (key, n, ids, counts) of documents with a wanted term, and
    a task's sums (term, count): document frequencies, documents (-1) and terms (-2) in all."""
    names = ["key", "n", "ids", "counts", "term", "count"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        frequency, sums, kind = np.zeros(len(known), np.int64), [0, 0], None
        for batch in slices(batches, "text"):
            kind = batch.schema.field("key").type
            split = [terms_of(t) for t in texts_of(batch.column("text"))]
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            total = int(lengths.sum())
            sums = [sums[0] + int((lengths > 0).sum()), sums[1] + total]
            ids = np.fromiter(map(known.get, (t for s in split for t in s), repeat(-1)), np.int64,
                              total)
            held = np.flatnonzero(ids >= 0)
            owner = np.repeat(np.arange(len(split)), lengths)[held]
            code, counts = np.unique(owner * max(1, len(known)) + ids[held], return_counts=True)
            owner, ids = np.divmod(code, max(1, len(known)))
            frequency += np.bincount(ids, minlength=len(known))
            rows, first = np.unique(owner, return_index=True)
            offsets = pa.array(np.append(first, len(ids)).astype(np.int32) * 4)
            if len(rows):
                data = [pa.Array.from_buffers(pa.binary(), len(rows), [
                    None, offsets.buffers()[1], pa.py_buffer(v.astype("<u4").tobytes())])
                    for v in (ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows)), pa.array(lengths[rows]), *data,
                     pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64())], names)
        if kind is not None:
            seen = np.flatnonzero(frequency)
            rows = len(seen) + 2
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, kind), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()),
                 pa.nulls(rows, pa.binary()),
                 pa.array([_DOCUMENTS, _TERMS, *seen.tolist()], pa.int32()),
                 pa.array([*sums, *frequency[seen].tolist()], pa.int64())], names)

    return stage(docs.mapInArrow(look, f"key {key_type}, n long, ids binary, counts binary, "
                                       "term int, count long"), "term-vectors")


def saturation(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds per unit of weight."""
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class DocumentTree:
    """Frequent-pattern tree of one group: nodes are runs of the documents in path order."""

    def __init__(self, keys: list, m: np.ndarray, sizes: np.ndarray, ranks: np.ndarray,
                 counts: np.ndarray, terms: int):
        """Vectors one after the other, ``sizes`` entries each, ranks ascending in each."""
        starts = np.cumsum(sizes) - sizes
        path = ranks.astype(">u4").tobytes()
        paths = [path[4 * b:4 * (b + s)] for b, s in zip(starts.tolist(), sizes.tolist())]
        order = sorted(range(len(keys)), key=paths.__getitem__)
        turn = np.array(order)
        self.keys, sizes = [keys[i] for i in order], sizes[turn]
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        entry = np.repeat(starts[turn] - self.begins[:-1], sizes) + np.arange(len(ranks))
        self.ranks, counts, m = ranks[entry], counts[entry], m[turn]
        owner = np.repeat(np.arange(len(order)), sizes)
        self.adds = saturation(counts, m[owner])
        self._grow([paths[i] for i in order])
        self._summarise(owner, counts, m, terms)

    def _grow(self, paths: list[bytes]) -> None:
        """Nodes as (first, last, parent), parents before their children; leaves have none."""
        n = len(paths)
        shared = [0] * (n + 1)  # common terms of a path with the one before
        for i in range(1, n):
            a, b = np.frombuffer(paths[i - 1], ">u4"), np.frombuffer(paths[i], ">u4")
            short = min(len(a), len(b))
            differ = np.flatnonzero(a[:short] != b[:short])
            shared[i] = int(differ[0]) if len(differ) else short
        runs, open_runs = [], [(0, 0)]  # (first, depth): runs that share a path of that depth
        for i in range(1, n + 1):
            first = i - 1
            while open_runs and open_runs[-1][1] > shared[i]:
                first, depth = open_runs.pop()
                runs.append((first, i))
            if i < n and (not open_runs or open_runs[-1][1] < shared[i]):
                open_runs.append((first, shared[i]))
        runs = sorted({r for r in runs if r[1] - r[0] > _LEAF}, key=lambda r: (r[0], -r[1]))
        nodes, stack = [(0, n, -1)], [0]
        children: list[list[int]] = [[]]

        def add(first: int, last: int, parent: int) -> int:
            nodes.append((first, last, parent))
            children.append([])
            children[parent].append(len(nodes) - 1)
            return len(nodes) - 1

        for first, last in runs:
            while nodes[stack[-1]][1] <= first:
                stack.pop()
            above = nodes[stack[-1]]
            if 2 * (last - first) <= above[1] - above[0]:
                stack.append(add(first, last, stack[-1]))
        self.leaves = {}
        for node in range(len(nodes)):  # what no child holds becomes leaves
            at, last, _ = nodes[node]
            for first, end in [*((nodes[c][0], nodes[c][1]) for c in children[node]), (last, last)]:
                while at < first:
                    step = min(_LEAF, first - at)
                    leaf = add(at, at + step, node)
                    self.leaves[leaf] = (at, at + step)
                    at += step
                at = max(at, end)
        self.nodes, self.children = nodes, children

    def _summarise(self, owner: np.ndarray, counts: np.ndarray, m: np.ndarray, terms: int) -> None:
        """Largest count per (node, term), from the leaves upwards, and smallest m per node."""
        leaf_of = np.zeros(len(m), np.int64)
        for leaf, (first, last) in self.leaves.items():
            leaf_of[first:last] = leaf
        parent = np.array([p for _, _, p in self.nodes])
        depth = np.zeros(len(self.nodes), np.int64)
        for node in range(1, len(parent)):  # parents come before their children
            depth[node] = depth[parent[node]] + 1
        least = np.full(len(self.nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, leaf_of, m)
        held = []
        code, most = self._largest(leaf_of[owner] * terms + self.ranks, counts)
        for level in range(int(depth.max()), -1, -1):
            node = code // terms
            now = depth[node] == level
            held.append((code[now], most[now]))
            if level:
                own = np.flatnonzero(depth == level)
                np.minimum.at(least, parent[own], least[own])
                up = np.where(now, parent[node], node) * terms + code % terms
                code, most = self._largest(up, most)
        code, most = (np.concatenate(c) for c in zip(*held))
        node, rank = np.divmod(code, terms)
        order = np.argsort(rank, kind="stable")
        self.entry_node = node[order]
        self.entry_adds = saturation(most, least[node])[order]
        self.entry_begins = np.searchsorted(rank[order], np.arange(terms + 1)).tolist()

    @staticmethod
    def _largest(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(code, kind="stable")
        code, counts = code[order], counts[order]
        heads = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        return code[heads], np.maximum.reduceat(counts, heads)

    def bounds(self, ranks: list[int], weights: list[int]) -> np.ndarray:
        """Per node the most that a document below can score."""
        total = np.zeros(len(self.nodes), np.int64)
        for rank, weight in zip(ranks, weights):
            begin, end = self.entry_begins[rank], self.entry_begins[rank + 1]
            total[self.entry_node[begin:end]] += weight * self.entry_adds[begin:end]
        return total

    def search(self, ranks: list[int], weights: list[int], dense: np.ndarray, best: list,
               top: int) -> None:
        """Put the documents that are among the ``top`` into ``best``: (-score, no key, key) in
        order. ``dense`` is zero for all terms and is left so."""
        bounds = self.bounds(ranks, weights)
        if bounds[0] <= 0 or (len(best) == top and bounds[0] < -best[-1][0]):
            return
        dense[ranks] = weights
        limits, stack = bounds.tolist(), [0]
        while stack:
            node = stack.pop()
            if limits[node] <= 0 or (len(best) == top and limits[node] < -best[-1][0]):
                continue
            if node not in self.leaves:
                stack += sorted(self.children[node], key=limits.__getitem__)
                continue
            first, last = self.leaves[node]
            begin, end = self.begins[first], self.begins[last]
            adds = dense[self.ranks[begin:end]] * self.adds[begin:end]
            scores = np.add.reduceat(adds, self.begins[first:last] - begin).tolist()
            for i, score in enumerate(scores, first):
                if score > 0 and (len(best) < top or score >= -best[-1][0]):
                    key = self.keys[i]
                    insort(best, (-score, key is None, 0 if key is None else key))
                    del best[top:]
        dense[ranks] = 0


def search_vectors(vectors: DataFrame, plan, key_type: str, top: int) -> DataFrame:
    """(item, key, score): the best documents of every task for every item number."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, numbers, items, documents, terms = plan.value
        best: list[list] = [[] for _ in items]
        dense = np.zeros(len(rank_of), np.int64)
        group: list[tuple] = []
        kind = None

        def close() -> None:
            keys = [k for part in group for k in part[0]]
            lengths = [n for part in group for n in part[1]]
            sizes = np.concatenate([part[2] for part in group])
            ranks = rank_of[np.concatenate([part[3] for part in group])]
            counts = np.concatenate([part[4] for part in group])
            owner = np.repeat(np.arange(len(keys)), sizes)
            order = np.argsort(owner * len(rank_of) + ranks, kind="stable")
            m = np.array([100 - 75 + 75 * n * documents // terms for n in lengths], np.int64)
            tree = DocumentTree(keys, m, sizes, ranks[order], counts[order], len(rank_of))
            for (ranks, weights), own in zip(items, best):
                tree.search(ranks, weights, dense, own, top)
            group.clear()

        for whole in batches:
            kind = whole.schema.field("key").type
            for at in range(0, whole.num_rows, _GROUP):
                batch = whole.slice(at, _GROUP)
                ids, counts = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").astype(
                    np.int64) for c in ("ids", "counts"))
                sizes = np.array([len(v) // 4 for v in batch.column("ids").to_pylist()])
                held = sum(len(part[0]) for part in group), sum(len(part[3]) for part in group)
                if group and (held[0] + batch.num_rows > _GROUP or held[1] + len(ids) > _ENTRIES):
                    close()
                group.append((batch.column("key").to_pylist(), batch.column("n").to_pylist(),
                              sizes, ids, counts))
        if group:
            close()
        found = [(number, None if none else key, -score)
                 for number, own in zip(numbers, best) for score, none, key in own]
        if found:
            own, keys, scores = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(keys, kind), pa.array(scores, pa.int64())],
                ["number", "key", "score"])

    return vectors.mapInArrow(find, f"number long, key {key_type}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, block: int = 20_000,
                   key: str = "doc_id", text: str = "text", item: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """``item``, rank, ``key``, score: the ``top`` documents with a score above 0 per item.

    Equal scores go by ascending key, null keys last; repeated documents are ranked one by one.
    Null and empty texts have no terms and match nothing. An item is a distinct (``item``, text);
    empty tables give no rows. Other columns are not read.

    The items are a stated query set. They are taken in blocks of about ``block``, one pass over
    the texts each, whose terms and weights are broadcast; statistics always cover all documents.
    """
    spark = docs.sparkSession
    key_type, item_type = (docs.schema[key].dataType.simpleString(),
                           items.schema[item].dataType.simpleString())
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    asked = stage(items.select(items[item].alias("item"), items[item_text].alias("text"))
                  .where(items[item_text].isNotNull()).distinct()
                  .withColumn("number", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        part = _rank_block(own, rows, key_type, top)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked, "number").select(
        F.col("item").cast(item_type).alias(item), "rank", F.col("key").alias(key), "score")


def _rank_block(docs: DataFrame, items: DataFrame, key_type: str, top: int) -> DataFrame:
    """(number, key, score) of the best documents of every task for a block of items."""
    spark = docs.sparkSession
    asked = [(r["number"], terms_of(r["text"])) for r in items.collect()]
    known = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    vocabulary = spark.sparkContext.broadcast(known)
    seen = restricted_vectors(docs, vocabulary, key_type)
    sums = {r["term"]: r["n"] for r in seen.where("term IS NOT NULL").groupBy("term").agg(
        F.sum("count").alias("n")).collect()}  # as many rows as the block has terms
    documents, terms = sums.pop(_DOCUMENTS, 0), sums.pop(_TERMS, 0)
    frequency = np.array([sums.get(i, 0) for i in range(len(known))], np.int64)
    weight = [floor(1000 * log((2 * documents + 2) / (2 * f + 1))) for f in frequency.tolist()]
    rank_of = np.empty(len(known), np.int64)
    rank_of[np.argsort(-frequency, kind="stable")] = np.arange(len(known))
    plans = []
    for _, own in asked:
        ids, repeats = np.unique(np.array([known[t] for t in own], np.int64), return_counts=True)
        plans.append((rank_of[ids].tolist(),
                      [weight[i] * r for i, r in zip(ids.tolist(), repeats.tolist())]))
    plan = spark.sparkContext.broadcast(
        (rank_of, [n for n, _ in asked], plans, documents, max(1, terms)))
    found = stage(search_vectors(seen.where("n IS NOT NULL").select("key", "n", "ids", "counts"),
                                 plan, key_type, top), "found")
    vocabulary.destroy()
    plan.destroy()
    return found
