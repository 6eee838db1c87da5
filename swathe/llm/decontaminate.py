"""Benchmark decontamination: every passage of every text is a BM25 query against the test items.

The test items form an inverted index. A passage retrieves all items whose BM25 score reaches a
share of the item's score with itself; impacts are divided by that bound, so the threshold is 1
for every item. Candidates are found by block-max WAND: items stand in blocks, every term has its
largest impact per block, and a block is opened only if the block maxima of the passage's terms
reach the threshold. The sums of block maxima are made for all passages of a batch at once; terms
that most items share enter them as one constant per block, the most that they can add. Inside an
open block the pivot rule skips items, and the rest is scored in full. A hit counts when
word sequences of both the item's question and its answer stand in the passage.

Passages are windows of twice the longest item that advance by the longest item, so any stretch
as long as an item lies in one of them whole. Where a script has no spaces between words every
character is a term. Items of a few terms have no score to speak of: they are found where all their
terms stand in a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from swathe.llm.tasks import slices, texts_of
from swathe.sources.staging import stage

K1, B = 1.2, 0.75
_PLAIN = re.compile(r"[\W_]+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*")
# Fixed: blocks of Thai, Lao, Tibetan, Myanmar, Khmer, Kana and Han characters.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf"
                       "\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f]")


def words_of(text: str) -> list[str]:
    """What stands between white space; characters of unspaced scripts one by one."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.split()


def term_of(word: str) -> str:
    """A word in lower case without anything but letters and digits."""
    return _PLAIN.sub("", word).lower()


def terms_of(text: str) -> list[str]:
    return [t for t in map(term_of, words_of(text)) if t]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Terms of an item's question and answer: the last sentence answers, or of a single sentence
    the last third; both have at least three terms where the item has six."""
    sentences = _SENTENCES.split(text.strip())
    terms = terms_of(text)
    n = len(terms_of(sentences[-1])) if len(sentences) > 1 else len(terms) // 3
    n = min(max(n, 3), max(1, len(terms) - 3))
    return terms[:-n], terms[-n:]


def sequences(terms: list[int], n: int = 3) -> set[tuple[int, ...]]:
    n = min(n, len(terms))
    return {tuple(terms[i:i + n]) for i in range(len(terms) - n + 1)} if n else set()


@dataclass
class Index:
    """Inverted index of one shard of test items; fits the shard limit of the caller."""

    keys: list            # item keys by position
    terms: dict[str, int]
    postings: list        # per term: (positions, impacts) as lists
    block: int            # items per block
    maxima: np.ndarray    # term x block: largest impact
    common: np.ndarray    # per term: enters the sums as a constant
    ceiling: np.ndarray   # per block: most that common terms can add
    parts: list           # per item: (question sequences, answer sequences, their length)
    longest: int          # terms of the longest item
    threshold: float
    short: dict           # by length: {sequence of terms: positions in keys}


def build_index(items: list[tuple[object, str]], threshold: float, least_terms: int,
                statistics: tuple[int, float, dict[str, int]] | None = None, least_short: int = 3
                ) -> Index:
    """Index of (key, text) items, in key order. ``statistics`` are those of all items with at
    least ``least_terms`` terms: how many, their mean length, and how many have a term."""
    parsed = [(k, terms_of(t or ""), t or "") for k, t in items]
    parsed = sorted((p for p in parsed if len(p[1]) >= least_short and p[0] is not None),
                    key=lambda p: (p[0], p[2]))
    few = [p for p in parsed if len(p[1]) < least_terms]
    parsed = [p for p in parsed if len(p[1]) >= least_terms]
    vocabulary: dict[str, int] = {}
    counts: list[dict[int, int]] = []
    for _, terms, _ in parsed:
        own: dict[int, int] = {}
        for t in terms:
            i = vocabulary.setdefault(t, len(vocabulary))
            own[i] = own.get(i, 0) + 1
        counts.append(own)
    n, v = len(parsed), len(vocabulary)
    frequency = np.zeros(v)
    for own in counts:
        frequency[list(own)] += 1
    if statistics is None:
        everyone, mean, held = n, sum(len(t) for _, t, _ in parsed) / max(1, n), frequency
    else:
        everyone, mean, held = statistics[0], statistics[1], np.array(
            [statistics[2][t] for t in vocabulary], float)
    idf = np.log1p((everyone - held + 0.5) / (held + 0.5))
    block = max(8, -(-n // 64))
    maxima = np.zeros((v, -(-n // block) if n else 0), np.float32)
    common = frequency > max(8, n / 20)
    ceiling = np.zeros(maxima.shape[1], np.float32)
    postings: list = [([], []) for _ in range(v)]
    for i, (own, (_, terms, _)) in enumerate(zip(counts, parsed)):
        norm = K1 * (1 - B + B * len(terms) / mean)
        impacts = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in own.items()}
        bound = threshold * sum(impacts.values())
        for t, impact in impacts.items():
            share = impact / bound
            postings[t][0].append(i)
            postings[t][1].append(share)
            maxima[t, i // block] = max(maxima[t, i // block], np.float32(share * (1 + 1e-6)))
        ceiling[i // block] = max(ceiling[i // block], sum(
            impact for t, impact in impacts.items() if common[t]) / bound)
    parts = []
    for _, terms, text in parsed:
        question, answer = question_and_answer(text)
        ids = [[vocabulary[t] for t in side] for side in (question, answer)]
        parts.append(tuple((sequences(side), min(3, len(side))) for side in ids))
    short: dict[int, dict[tuple, list[int]]] = {}
    for i, (_, terms, _) in enumerate(few, n):
        ids = tuple(vocabulary.setdefault(t, len(vocabulary)) for t in terms)
        short.setdefault(len(ids), {}).setdefault(ids, []).append(i)
    more = len(vocabulary) - v  # terms of short items only: they add nothing to a score
    return Index([k for k, _, _ in parsed + few], vocabulary, postings + [([], [])] * more, block,
                 np.pad(maxima, ((0, more), (0, 0))), np.pad(common, (0, more)), ceiling, parts,
                 max((len(t) for _, t, _ in parsed), default=0), threshold, short)


def wand(index: Index, terms: list[int], block: int) -> dict[int, float]:
    """Items of ``block`` whose score for the distinct ``terms`` reaches 1.

    Cursors stand on each term's next posting in the block. In order of position the block maxima
    are added until they reach 1: the item there is the pivot, and no earlier one can reach it.
    """
    first, last = block * index.block, (block + 1) * index.block
    cursors = []
    for t in terms:
        most = float(index.maxima[t, block])
        if most > 0:
            positions, impacts = index.postings[t]
            own = [(p, w) for p, w in zip(positions, impacts) if first <= p < last]
            cursors.append([own[0][0], 0, own, most])
    found: dict[int, float] = {}
    while True:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, None
        for c in cursors:
            total += c[3]
            if total >= 1 - 1e-9:
                pivot = c[0]
                break
        if pivot is None or pivot >= last:
            return found
        score = 0.0
        for c in cursors:
            while c[0] < pivot:
                c[1] += 1
                c[0] = c[2][c[1]][0] if c[1] < len(c[2]) else last
            if c[0] == pivot:
                score += c[2][c[1]][1]
                c[1] += 1
                c[0] = c[2][c[1]][0] if c[1] < len(c[2]) else last
        if score >= 1 - 1e-9:
            found[pivot] = score


class TermTable(dict):
    """Raw word to term of the index: -1 for foreign terms, -2 for words without a term. Bounded."""

    def __init__(self, terms: dict[str, int], limit: int = 500_000):
        self.terms, self.limit = terms, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        term = term_of(word)
        self[word] = found = self.terms.get(term, -1) if term else -2
        return found


def terms_in(table: TermTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all texts in a row, and the text of each."""
    split = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter(map(table.__getitem__, (w for s in split for w in s)), np.int64,
                      int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    real = ids > -2
    return ids[real], owner[real]


def passages(index: Index, ids: np.ndarray, owner: np.ndarray, texts: int
             ) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(text, terms of the window, blocks to open) of windows in which a block may reach 1."""
    stride = max(32, index.longest)
    if not len(ids) or not index.parts:
        return
    counts = np.bincount(owner, minlength=texts)
    starts = np.cumsum(counts) - counts
    cells = -(-counts // stride)            # a text's windows: cells k and k + 1
    base = np.cumsum(cells) - cells
    cell = base[owner] + (np.arange(len(ids)) - starts[owner]) // stride
    telling = (ids >= 0) & ~index.common[np.maximum(ids, 0)]
    sums = np.zeros((int(cells.sum()) + 1, index.maxima.shape[1]), np.float32)
    own_cells, own_ids = cell[telling], ids[telling]
    if len(own_ids):
        heads = np.flatnonzero(np.concatenate(([True], own_cells[1:] != own_cells[:-1])))
        sums[own_cells[heads]] = np.add.reduceat(index.maxima[own_ids], heads, axis=0)
    lead = np.repeat(np.arange(texts), cells)
    two = sums[:-1].copy()
    follows = np.concatenate((lead[1:] == lead[:-1], [False]))
    two[follows] += sums[1:][follows]
    may = two + index.ceiling >= 1 - 1e-4
    for k in np.flatnonzero(may.any(axis=1)).tolist():
        text = int(lead[k])
        begin = int(starts[text] + (k - base[text]) * stride)
        end = min(int(starts[text] + counts[text]), begin + 2 * stride)
        yield text, ids[begin:end], np.flatnonzero(may[k]).tolist()


def short_items(index: Index, ids: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """(text, item position) where all terms of a short item stand in a row."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    for length, items in index.short.items():
        rows = len(ids) - length + 1
        if rows <= 0:
            continue

        def mark(terms: np.ndarray) -> np.ndarray:
            """A number per column of ``length`` rows of terms; equal ones share it."""
            total = np.zeros(terms.shape[1], np.uint64)
            for row in terms:
                total = (total + row.astype(np.uint64) + np.uint64(1)) * odd
                total ^= total >> np.uint64(29)
            return total

        windows = np.stack([ids[k:k + rows] for k in range(length)])
        wanted = mark(np.array(list(items), np.int64).T)
        inside = (windows >= 0).all(axis=0) & (owner[:rows] == owner[length - 1:])
        for at in np.flatnonzero(inside & np.isin(mark(windows), wanted)).tolist():
            for position in items.get(tuple(windows[:, at].tolist()), ()):
                yield int(owner[at]), position


def hits(index: Index, table: TermTable, texts: list[str], overlap: float
         ) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item position): best passage's score, question and answer overlap."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    ids, owner = terms_in(table, texts)
    for row, window, blocks in passages(index, ids, owner, len(texts)):
        terms = np.unique(window[window >= 0]).tolist()
        seen = None
        for block in blocks:
            for position, score in wand(index, terms, block).items():
                seen = seen or sequences_of(window)
                shares = [len(seqs & seen[n]) / len(seqs) for seqs, n in index.parts[position]]
                if min(shares) >= overlap:
                    hit = (score, *shares)
                    best[row, position] = max(best.get((row, position), hit), hit)
    for row, position in short_items(index, ids, owner):
        best[row, position] = (1 / index.threshold, 1.0, 1.0)
    return best


def index_shards(items: DataFrame, threshold: float, least_terms: int, shard: int, item: str,
                 item_text: str) -> Iterator:
    """Broadcast indexes of the benchmark, one per shard; statistics are those of all items."""
    kind = items.schema[item].dataType.simpleString()
    tests = items.select(items[item].alias("item"), items[item_text].alias("text")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array(map(terms_of, texts_of(batch.column("text"))), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, terms], ["item", "text", "terms"])

    rows = stage(tests.mapInArrow(split, f"item {kind}, text string, terms array<string>"), "items")
    scored = rows.where(F.col("item").isNotNull() & (F.size("terms") >= least_terms))
    held = scored.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count()
    everyone, mean = scored.agg(F.count("*"), F.avg(F.size("terms"))).first()
    shards = max(1, -(-rows.count() // shard))
    for number in range(shards):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == number)
        own = mine.select(F.explode("terms").alias("term")).distinct()
        found = {r["term"]: r["count"] for r in held.join(own, "term").collect()}
        yield items.sparkSession.sparkContext.broadcast(build_index(
            [(r["item"], r["text"]) for r in mine.select("item", "text").collect()], threshold,
            least_terms, (everyone, mean or 0.0, found)))


def contaminated_by(docs: DataFrame, items: DataFrame, threshold: float = 0.6,
                    overlap: float = 0.5, least_terms: int = 6, shard: int = 20_000,
                    key: str = "doc_id", text: str = "text", item: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """(``key``, ``item``, score, question_overlap, answer_overlap) of every contaminated row.

    score is the best passage's BM25 score as a share of the item's own; the overlaps are the
    shares of the question's and the answer's three-term sequences that stand in that passage,
    both at least ``overlap``. An item of 3 to ``least_terms`` - 1 terms counts where all its terms
    stand in a row (score and overlaps 1); one or two terms cannot be told from ordinary text and
    are not searched. Null texts hold nothing; null and repeated document keys
    are reported by themselves, one row per row and item; null items are not searched, items that
    repeat are reported once for each distinct text. Empty tables give no rows. Other columns are
    not read.

    The benchmark is a stated query set. It is cut into shards of about ``shard`` items, each
    indexed and broadcast by itself (some 100 bytes per term), with BM25 statistics of all items;
    more items mean more passes over the texts, not larger broadcasts. Texts are not shuffled.
    """
    kinds = [docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()]
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    item_type = to_arrow_type(items.schema[item].dataType)
    out = None
    for shared in index_shards(items, threshold, least_terms, shard, item, item_text):
        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            table = TermTable(index.terms)
            for batch in slices(batches, "text"):
                keys = batch.column("key").to_pylist()
                found = hits(index, table, texts_of(batch.column("text")), overlap)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[row] for row, _ in found],
                                  batch.schema.field("key").type),
                         pa.array([index.keys[position] for _, position in found], item_type),
                         *(pa.array(list(c)) for c in zip(
                             *((s * threshold, q, a) for s, q, a in found.values())))],
                        ["key", "item", "score", "question_overlap", "answer_overlap"])

        part = own.mapInArrow(search, f"key {kinds[0]}, item {kinds[1]}, score double, "
                                      "question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item})


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6,
                      overlap: float = 0.5, least_terms: int = 6, shard: int = 20_000,
                      text: str = "text", item: str = "item_id", item_text: str = "text"
                      ) -> DataFrame:
    """The rows of ``docs``, with all columns, in which :func:`contaminated_by` finds nothing."""
    for shared in index_shards(items, threshold, least_terms, shard, item, item_text):
        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            table = TermTable(index.terms)
            for batch in slices(batches, text):
                found = hits(index, table, texts_of(batch.column(text)), overlap)
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in found]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def sequences_of(window: np.ndarray) -> dict[int, set[tuple[int, ...]]]:
    """The window's term sequences by length 1 to 3."""
    terms = window.tolist()
    return {n: sequences(terms, n) for n in (1, 2, 3)}
