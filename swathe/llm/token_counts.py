"""Token counts by byte-pair merging, without emitting identifiers.

A word's bytes form a linked list; a heap holds its adjacent pairs by merge rank. The lowest rank
(leftmost first among equals) is popped and its two symbols joined, until no pair has a rank. The
count is the number of bytes less the number of merges. Words are cut from whole texts by the
tokenizer's own pattern, and words seen before are looked up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from swathe.llm.tasks import kept, slices, texts_of
from swathe.llm.tokens import (
    VOCABULARY,
    ChunkTable,
    byte_letters,
    byte_level_words,
    vocabulary_path,
)


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when all merges are done, in O(n log n)."""
    n = left = len(symbols)
    symbols = list(symbols)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:]))
            if (rank := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = following[i]
        # The entry is stale if either symbol has been merged since.
        if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
            continue
        symbols[i], symbols[j] = pair[0] + pair[1], ""
        following[i] = after = following[j]
        left -= 1
        if after < n:
            before[after] = i
        for a, b in ((before[i], i), (i, after)):
            if a >= 0 and b < n:
                new = (symbols[a], symbols[b])
                rank = ranks.get(new)
                if rank is not None:
                    heapq.heappush(heap, (rank, a, new))
    return left


class MergeCounts(ChunkTable):
    """Counts of a byte-level BPE vocabulary (JSON with merges and added tokens)."""

    def __init__(self, path: str, limit: int = 500_000):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not byte_level_words(path):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.ranks = {tuple(m): r for r, m in enumerate(spec["model"]["merges"])}
        self.letters = byte_letters()
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.word_counts: dict[str, int] = {}
        added = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(
            added, key=len, reverse=True))) + ")") if added else None
        super().__init__(added, limit)

    def count_word(self, word: str) -> int:
        found = self.word_counts.get(word)
        if found is None:
            letters = self.letters
            found = merged_length([letters[b] for b in word.encode()], self.ranks)
            if len(word) <= 32:
                if len(self.word_counts) > self.limit:
                    self.word_counts.clear()
                self.word_counts[word] = found
        return found

    def measure(self, texts: list[str]) -> list[int]:
        count, words, cut = self.count_word, self.words.findall, self.cut
        out = []
        for text in texts:
            # Odd places of the split are special strings: one token each.
            parts = cut.split(text) if cut else [text]
            out.append(len(parts) // 2 + sum(count(w) for p in parts[::2] for w in words(p)))
        return out


def token_counts(docs: DataFrame, limit: int = 512, vocabulary: str = VOCABULARY,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    One narrow pass, no shuffle. A null text counts as empty (0 bytes, 0 tokens); null or repeated
    keys are kept as they are, one row out per row in; other columns are not read. Very long texts
    and words cost O(n log n). A special string inside a text is one token.
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(("merges", vocabulary), lambda: MergeCounts(vocabulary_path(vocabulary)))
        for batch in slices(batches, "text"):
            texts = texts_of(batch.column("text"))
            n = pa.array(table.totals(texts), pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), size, n, pc.greater(n, limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean"
    ).withColumnRenamed("key", key)
