"""Token ids of whole texts, with the chunks between spaces and line breaks encoded once.

The byte-level tokenizers used here cut a text into words before merging. A word spans neither a
line break nor the border before a space, unless three white-space characters follow each other
or two end the text. So a text's ids are those of its chunks and breaks in a row, and a chunk that
was seen before needs no second encoding; nor does one that only adds closing punctuation. Texts
with such white space or with special strings go through the library whole. Tables are bounded:
they start anew when they are full.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from swathe.llm.tasks import kept

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that calls this; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_ODD_SPACE = re.compile(r"\s\s(?:\s|\Z)")
_CLOSING = ".,;:!?"
_LONGEST = 64  # characters of a key of which parts are looked up
BREAK = " \n"


def chunked(text: str, specials: Sequence[str]) -> list[str]:
    """Keys of a text's chunks: one that follows a space as it is, one at the beginning of a line
    (or a text that stays whole) with a space in front."""
    if _ODD_SPACE.search(text) or any(s in text for s in specials):
        return [" " + text]
    if "\n" not in text:
        keys = text.split(" ")
        keys[0] = " " + keys[0]
        return keys
    keys = []
    for line in text.split("\n"):
        parts = line.split(" ")
        parts[0] = " " + parts[0]
        keys += parts
        keys.append(BREAK)
    keys.pop()
    return keys


def spelled(key: str) -> str:
    """The text that a key of :func:`chunked` stands for."""
    return key[1:] if key[:1] == " " else " " + key


class Positions(dict):
    """Key to position; -1 for unknown keys."""

    def __missing__(self, key: str) -> int:
        return -1


class ChunkTable:
    """Number of tokens of every chunk seen, by :meth:`measure`."""

    def __init__(self, specials: Sequence[str], limit: int = 500_000):
        self.specials, self.limit = tuple(specials), limit
        self.clear()

    def clear(self) -> None:
        self.index = Positions()
        self.chars = 0
        self.lengths = np.zeros(1 << 16, np.int64)

    def measure(self, texts: list[str]) -> list[int]:
        raise NotImplementedError

    def enter(self, keys: list[str], lengths) -> None:
        first = len(self.index)
        if first + len(keys) > len(self.lengths):
            self.lengths = np.resize(self.lengths, 2 * (first + len(keys)))
        self.lengths[first:first + len(keys)] = lengths
        self.index.update(zip(keys, range(first, first + len(keys))))
        self.chars += sum(map(len, keys))

    def join(self, cores: list[int], tails: list[int]):
        """Lengths of new entries that are two old ones in a row."""
        return self.lengths[cores] + self.lengths[tails]

    def add(self, keys: list[str]) -> None:
        """Enter new keys. Where punctuation closes a word, word and punctuation are looked up."""
        ends = tuple(_CLOSING)
        pairs = [(k, c, " " + k[len(c):]) for k in keys if k.endswith(ends) and len(k) <= _LONGEST
                 and (c := k.rstrip(_CLOSING))[-1:].isalpha()]
        closed = {k for k, _, _ in pairs}
        plain = [k for k in keys if k not in closed]
        plain += sorted({p for _, *both in pairs for p in both}.difference(self.index, plain))
        if plain:
            self.enter(plain, self.measure([spelled(k) for k in plain]))
        if pairs:
            index = self.index
            self.enter([k for k, _, _ in pairs], self.join(
                [index[c] for _, c, _ in pairs], [index[t] for _, _, t in pairs]))

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table positions of the chunks of all texts in a row, and chunks per text."""
        if len(self.index) > self.limit or self.chars > 16 * self.limit:
            self.clear()
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            parts = [chunked(text, self.specials) for text in texts]
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            keys = list(chain.from_iterable(parts))
            at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
            missing = np.flatnonzero(at < 0).tolist()
            if missing:
                self.add(list(dict.fromkeys([keys[i] for i in missing])))
                at[missing] = [self.index[keys[i]] for i in missing]
            return at, counts
        finally:
            if collecting:
                gc.enable()

    def totals(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        at, counts = self.look_up(texts)
        sums = np.concatenate(([0], np.cumsum(self.lengths[at])))
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]


class IdTable(ChunkTable):
    """Token ids of every chunk seen; ``encode`` gives the ids of a list of texts."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], specials: Sequence[str],
                 dtype: str = "<u4", limit: int = 500_000):
        self.encode_all, self.dtype = encode, dtype
        super().__init__(specials, limit)

    def clear(self) -> None:
        super().clear()
        self.starts = np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0

    def measure(self, texts: list[str]) -> list[int]:
        found = self.encode_all(texts)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.fill(np.fromiter(chain.from_iterable(found), self.dtype, int(lengths.sum())), lengths)
        return lengths

    def join(self, cores: list[int], tails: list[int]):
        at = np.array([cores, tails]).T.ravel()
        lengths = super().join(cores, tails)
        self.fill(self.gather(at), lengths)
        return lengths

    def fill(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append the ids of the entries that are entered next."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        self.pool[self.used:self.used + len(ids)] = ids
        first, n = len(self.index), len(lengths)
        if first + n > len(self.starts):
            self.starts = np.resize(self.starts, 2 * (first + n))
        self.starts[first:first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of table entries in a row."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.arange(total) + np.repeat(self.starts[at] - (ends - lengths), lengths)]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        at, counts = self.look_up(texts)
        sums = np.concatenate(([0], np.cumsum(self.lengths[at])))
        last = np.cumsum(counts)
        return self.gather(at), sums[last] - sums[last - counts]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def byte_level_words(path: str) -> bool:
    """Whether the vocabulary cuts texts by the byte-level pattern and merges with BPE only."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"] or {}
    return (spec["model"]["type"] == "BPE" and spec["normalizer"] is None
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space") and not spec["model"].get("end_of_word_suffix"))


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def library_table(vocabulary: str = VOCABULARY) -> IdTable:
    """This worker's table of the tokenizers library, with ``add_special_tokens=False``."""
    def make() -> IdTable:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary_path(vocabulary)
        tokenizer = Tokenizer.from_file(path)
        merge = tokenizer.model.tokenize
        letters = byte_letters() if byte_level_words(path) else None

        def encode(texts: list[str]) -> list[list[int]]:
            found: list = [None] * len(texts)
            # A run of letters, or one behind a space, is one word to the tokenizer: its bytes'
            # letters go straight to the library's merging model.
            words = [i for i, t in enumerate(texts) if letters and t.removeprefix(" ").isalpha()]
            spelt = "\n".join([texts[i] for i in words]).encode().decode("latin-1").translate(
                {b: c for b, c in enumerate(letters or ()) if b != 10}).split("\n")
            for i, word in zip(words, spelt):
                found[i] = [token.id for token in merge(word)]
            others = [i for i, ids in enumerate(found) if ids is None]
            for i, e in zip(others, tokenizer.encode_batch_fast(
                    [texts[i] for i in others], add_special_tokens=False)):
                found[i] = e.ids
            return found

        small = tokenizer.get_vocab_size() <= 1 << 16
        return IdTable(encode, special_strings(path), "<u2" if small else "<u4")

    return kept(("ids", vocabulary), make)
