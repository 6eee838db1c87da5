"""Phrase collocations: level-wise candidates, counted by double-array tries.

1. One pass counts words per language exactly, and pairs and triples in hashed counters of fixed
   number that stop at the least count. A counter is never below the count of a phrase in it.
2. A second pass gives the spots at which a phrase may begin: those whose words and pair have
   counters that reach the least count, with the third word if it may belong to a phrase too. Spots
   are dealt to buckets by their pair, so that all occurrences of a phrase meet in one bucket. The
   number of buckets follows that of the words; equal spots of a task are one with a count.
3. In its bucket, a phrase is a candidate if its own counter there, and its first pair's, reach the
   least count. So every frequent phrase is among the candidates (the Apriori property), and few
   others are, however large the input is.
4. The candidates of a bucket become double-array tries of bounded size over (language, word, word,
   word). The states of all spots of the bucket advance together: the states after one word, from
   these after two, then after three. The states that accept are counted with ``bincount``.
5. Scores, cuts and the rule for phrases inside longer ones are joins of the counted candidates.

The texts are read twice, whatever the number of candidates. What a task holds is bounded by the
batch, the counters, a table of words, and the distinct spots of a bucket with one of its tries.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.llm.ngram_join import _mix
from swathe.llm.tasks import give_back, slices, texts_of
from swathe.sources.staging import stage

SLOT_BITS = 25       # counters for pairs, and as many for triples
_WORD_BITS = 22      # counters for words
_SLOTS = (2 << SLOT_BITS) + (1 << _WORD_BITS)
_CHUNK = 1 << 16     # counters in a row of their table
_WORDS = 250_000     # words that a task remembers
_HELD = 2_000_000    # spots that a task holds before it passes them on
_BUCKET = 1_000_000  # words of the input for which there is a bucket
_MOST = 4_000_000    # spots of a bucket before equal ones are made one
_PART = 250_000      # spots of a bucket that are counted together
_ROWS = 2_000_000    # bytes of packed spots in a batch
_SHARD = 1_000_000   # phrases in a trie
_PARTS = 64          # of a language, ranked by themselves first
_SLICE = 2_000_000   # bytes of text that a task looks at together
_UNKNOWN = "und"

# What ends a piece, and what stands between words.
_ENDS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(_SPACES)] = 1
_KINDS[list(_ENDS)] = 2
_BLANK = bytes(32 if k else b for b, k in enumerate(_KINDS.tolist()))


class Text:
    """The words of many texts in order: ``codes``, places in ``names``, where a word may be more than
    once, ``owner`` (number of the word's text), and ``run``: how many of the next words, up to two,
    stand in the same piece."""

    def __init__(self, texts: list[str]):
        encoded = [t.encode().lower() for t in texts]
        data = b"\n".join(encoded) + b"\n"
        kinds = _KINDS[np.frombuffer(data, np.uint8)]
        inside = kinds == 0
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        # A word with the blanks behind it: few forms a word, found without an object for each.
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(starts),
            [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)),
             pa.py_buffer(data.translate(_BLANK))]).dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.names = [w.rstrip(b" ") for w in coded.dictionary.to_pylist()]
        pieces = np.cumsum(kinds == 2, dtype=np.int32)[starts]
        one = np.zeros(len(starts), bool)
        one[:-1] = pieces[1:] == pieces[:-1]
        two = np.zeros(len(starts), bool)
        two[:-1] = one[:-1] & one[1:]
        self.run = one.astype(np.int8) + two
        ends = np.searchsorted(starts, np.cumsum([len(e) + 1 for e in encoded]))
        self.owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))

    def next(self, numbers: np.ndarray, k: int) -> np.ndarray:
        """The ``numbers`` of the words ``k`` places on, -1 beyond the piece."""
        found, live = np.full(len(numbers), -1, numbers.dtype), np.flatnonzero(self.run >= k)
        found[live] = numbers[live + k]
        return found


def _languages(batch: pa.RecordBatch) -> list[str]:
    return [_UNKNOWN if v is None else v for v in batch.column("lang").to_pylist()]


class WordTable:
    """Numbers and hashes of the words and languages that a task has met."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.langs: dict[str, int] = {}

    def number(self, text: Text) -> np.ndarray:
        ids = self.ids
        new = [w for w in dict.fromkeys(text.names) if w not in ids]
        ids.update(zip(new, range(len(self.names), len(self.names) + len(new))))
        self.names += new
        more = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        self.hashes = np.concatenate((self.hashes, more))
        return np.fromiter(map(ids.__getitem__, text.names), np.int64, len(text.names))[text.codes]

    def language(self, langs: list[str]) -> np.ndarray:
        return np.array([self.langs.setdefault(v, len(self.langs)) for v in langs], np.int64)


def phrase_slots(hashes: np.ndarray, salt: np.ndarray, run: np.ndarray) -> list[tuple]:
    """(positions, slots) of words, pairs and triples; each kind has counters of its own."""
    two, three = np.flatnonzero(run > 0), np.flatnonzero(run > 1)
    odd = [np.uint64(0x9E3779B97F4A7C15 * k % 2 ** 64) for k in (1, 3, 5, 7)]
    first = _mix(hashes ^ salt) * odd[0]
    second, third = _mix(hashes ^ odd[1]), _mix(hashes ^ odd[2])

    def slot(mark: np.ndarray, bits: int, begin: int) -> np.ndarray:
        return (_mix(mark) >> np.uint64(64 - bits)).astype(np.int64) + begin

    return [(np.arange(len(run)), slot(first, _WORD_BITS, 2 << SLOT_BITS)),
            (two, slot(first[two] + second[two + 1], SLOT_BITS, 0)),
            (three, slot((first[three] ^ odd[3]) + second[three + 1] + third[three + 2],
                         SLOT_BITS, 1 << SLOT_BITS))]


def _salts(langs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v.encode(), seed=1) for v in langs), np.uint64,
                       len(langs))


def _chunks(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Filled chunks of counters below 16: numbers of the filled places if they are few, else two
    counters in a byte."""
    for c, own in enumerate(counts.reshape(-1, _CHUNK)):
        places = np.flatnonzero(own)
        if len(places):
            if 3 * len(places) < _CHUNK // 2 - 1:
                yield c, places.astype("<u2").tobytes() + own[places].tobytes()
            else:
                yield c, b"\0" + (own[0::2] | own[1::2] << 4).tobytes()


def _add_chunk(total: np.ndarray, data: bytes) -> None:
    if len(data) == _CHUNK // 2 + 1:
        packed = np.frombuffer(data, np.uint8, offset=1)
        total[0::2] += packed & 15
        total[1::2] += packed >> 4
    else:
        n = len(data) // 3
        total[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, np.uint8, n, 2 * n)


def look(docs: DataFrame, least: int) -> DataFrame:
    """Staged rows of two kinds: word counts (lang, word, n), and counters of a task (chunk,
    data)."""
    names = ["lang", "word", "n", "chunk", "data"]
    most = min(least, 15)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counters = WordTable(), np.zeros(_SLOTS, np.uint8)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            codes, place = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)
            rows = len(codes)
            langs = pa.array(list(table.langs), pa.string()).take(pa.array(codes >> 40))
            words = pa.array(table.names, pa.binary()).take(pa.array(codes & (1 << 40) - 1))
            return pa.RecordBatch.from_arrays(
                [langs, words.cast(pa.string()), pa.array(sums), pa.nulls(rows, pa.int32()),
                 pa.nulls(rows, pa.binary())], names)

        for batch in slices(batches, "text", _SLICE):
            text, langs = Text(texts_of(batch.column("text"))), _languages(batch)
            if not len(text.codes):
                continue
            ids = table.number(text)
            held.append(np.unique(table.language(langs)[text.owner] << 40 | ids,
                                  return_counts=True))
            found = phrase_slots(table.hashes[ids], _salts(langs)[text.owner], text.run)
            slots, n = np.unique(np.concatenate([s for _, s in found]), return_counts=True)
            counters[slots] = np.minimum(counters[slots] + np.minimum(n, most), most)
            if sum(len(c) for c, _ in held) > _WORDS or len(table.names) > _WORDS:
                yield flush()
                held.clear()
                table.clear()
        if held:
            yield flush()
        for chunk, data in _chunks(counters):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()),
                 pa.array([chunk], pa.int32()), pa.array([data], pa.binary())], names)
        del table, counters, held
        give_back()

    return stage(docs.mapInArrow(
        count, "lang string, word string, n long, chunk int, data binary"), "phrase-look")


def safe_slots(seen: DataFrame, least: int) -> np.ndarray:
    """One bit per counter: it reaches ``least``. 9 MB, whatever the input's size."""
    most = min(least, 15)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(),
                                   batch.column("data").to_pylist()):
                total = totals.setdefault(chunk, np.zeros(_CHUNK, np.uint8))
                _add_chunk(total, data)
                np.minimum(total, most, out=total)
        for chunk, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()),
                 pa.array([np.packbits(total >= most).tobytes()], pa.binary())], ["chunk", "data"])

    bits = np.zeros(_SLOTS // 8, np.uint8)
    summed = (seen.where("chunk IS NOT NULL").select("chunk", "data").repartition("chunk")
              .mapInArrow(add, "chunk int, data binary"))
    for row in summed.collect():
        bits[row["chunk"] * _CHUNK // 8:][:_CHUNK // 8] = np.frombuffer(row["data"], np.uint8)
    return bits


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes as all of them allow, after how many these are."""
    size = 1 if (top := int(numbers.max(initial=0))) < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _dense(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (left, right), both from 0 to 2^31, and the place of each given one among them."""
    codes, places = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
    return codes >> 32, codes & (1 << 32) - 1, places


def merged(lang: np.ndarray, words: list[np.ndarray], n: np.ndarray
           ) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct spots with the sums of their counts. The third word is -1 where there is none."""
    langs, first, head = _dense(lang, words[0])
    heads, second, two = _dense(head, words[1])
    pairs, third, place = _dense(two, words[2] + 1)
    sums = np.bincount(place, n, len(pairs)).astype(np.int64)
    return langs[heads[pairs]], [first[heads[pairs]], second[pairs], third - 1], sums


def gather(docs: DataFrame, bits, buckets: int) -> DataFrame:
    """Spots at which a phrase may begin, packed by bucket: (bucket, langs, words, lang, first,
    second, third, n). ``words`` are joined by spaces; ``first`` to ``third`` are arrays of places in
    them, ``lang`` one of places in ``langs``. A third word that is none is beyond the last one."""
    names = ["bucket", "langs", "words", "lang", "first", "second", "third", "n"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        safe, table = bits.value, WordTable()
        held: list[np.ndarray] = []

        def holds(slots: np.ndarray) -> np.ndarray:
            return safe[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1 == 1

        def flush() -> Iterator[pa.RecordBatch]:
            spots = np.concatenate(held, axis=1)
            held.clear()
            order = np.argsort(spots[0], kind="stable")
            begins = np.flatnonzero(np.diff(spots[0][order])) + 1
            langs, rows, size = list(table.langs), [], 0
            for at in np.split(order, begins):
                own = spots[:, at].astype(np.int64)
                bucket = int(own[0, 0])
                used, place = np.unique(own[2:5], return_inverse=True)
                known, lang = np.unique(own[1], return_inverse=True)
                if none := int(used[0] < 0):
                    used = used[1:]
                place = (place - none).reshape(3, -1)
                place[2][place[2] < 0] = len(used)
                n, room = np.ones(len(lang), np.int64), len(used) + 1
                if len(known) * room ** 3 < 1 << 63:  # else equal spots stay apart
                    codes, n = np.unique(
                        ((lang * room + place[0]) * room + place[1]) * room + place[2],
                        return_counts=True)
                    lang, place = codes // room ** 3, [codes // room ** k % room for k in (2, 1, 0)]
                rows.append((bucket, [langs[v] for v in known.tolist()],
                             b" ".join([table.names[w] for w in used.tolist()]).decode(),
                             *map(_narrow, (lang, *place, n))))
                size += sum(map(len, rows[-1][2:]))
                if size > _ROWS:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.list_(pa.string()), pa.string(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

        for batch in slices(batches, "text", _SLICE):
            text, langs = Text(texts_of(batch.column("text"))), _languages(batch)
            if not len(text.codes):
                continue
            if len(table.names) > _WORDS:
                if held:
                    yield from flush()
                table.clear()
            ids, salt = table.number(text), _salts(langs)[text.owner]
            (_, one), (two, pairs), (three, triples) = phrase_slots(
                table.hashes[ids], salt, text.run)
            word = holds(one)
            may = word[two] & word[two + 1] & holds(pairs)
            pair = np.zeros(len(ids), bool)
            pair[two] = may
            long = three[pair[three] & pair[three + 1] & holds(triples)]
            third = np.full(len(ids), -1)
            third[long] = ids[long + 2]
            at = two[may]
            if len(at):
                held.append(np.stack([
                    pairs[may] * buckets >> SLOT_BITS, table.language(langs)[text.owner[at]],
                    ids[at], ids[at + 1], third[at]]).astype(np.int32))
            if sum(h.shape[1] for h in held) > _HELD:
                yield from flush()
        if held:
            yield from flush()
        table.clear()
        give_back()

    return docs.mapInArrow(send, """bucket int, langs array<string>, words string, lang binary,
        first binary, second binary, third binary, n binary""")


class Spots:
    """Spots of a bucket: ``lang`` and ``words`` (three arrays, the third with -1 for none) are numbers
    of ``langs`` and ``names``, ``n`` are counts."""

    def __init__(self, langs: pa.Array, names: pa.Array, lang: np.ndarray, words: list[np.ndarray],
                 n: np.ndarray):
        self.langs, self.names, self.lang, self.words, self.n = langs, names, lang, words, n

    @staticmethod
    def unpack(table: pa.Table) -> Spots:
        """All that :func:`gather` gives for a bucket."""
        split = pc.split_pattern(table.column("words").combine_chunks(), " ")
        coded, langs = split.flatten().dictionary_encode(), table.column("langs").combine_chunks()
        spoken = langs.flatten().dictionary_encode()
        ids, own = coded.indices.to_numpy(), spoken.indices.to_numpy()
        ends, stops = (np.append(0, np.cumsum(pc.list_value_length(c))) for c in (split, langs))
        held: list[list[np.ndarray]] = [[] for _ in range(5)]
        count = least = 0
        for i in range(table.num_rows):
            word, speech = np.append(ids[ends[i]:ends[i + 1]], np.int32(-1)), own[stops[i]:stops[i + 1]]
            lang, *words, n = (_wide(table.column(c)[i].as_py()) for c in (
                "lang", "first", "second", "third", "n"))
            for column, some in zip(held, (speech[lang], *(word[w] for w in words), n)):
                column.append(some)
            count += len(n)
            if count > max(_MOST, 2 * least):
                lang, *words, n = map(np.concatenate, held)
                lang, words, n = merged(lang, words, n)
                held = [[a.astype(np.int32)] for a in (lang, *words)] + [[n]]
                count = least = len(n)
        for k in range(5):  # one by one, so that no more than one of them is there twice
            held[k] = np.concatenate(held[k])
        return Spots(spoken.dictionary, coded.dictionary, held[0], held[1:4], held[4])

    def mark(self) -> np.ndarray:
        """Hashes of languages and pairs."""
        return _mix(_mix(self.lang.astype(np.uint64) << np.uint64(32) | self.words[0].astype(np.uint64))
                    + self.words[1].astype(np.uint64))

    def parts(self, size: int) -> Iterator[Spots]:
        """About ``size`` spots at a time, those of a pair together."""
        parts = 1 + len(self.n) // size
        if parts == 1:
            yield self
            return
        own = self.mark() % np.uint64(parts)
        for k in range(parts):
            at = np.flatnonzero(own == k)
            yield Spots(self.langs, self.names, self.lang[at], [w[at] for w in self.words], self.n[at])


def candidates(spots: Spots, least: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Distinct phrases of ``spots`` that may be there ``least`` times: languages, phrases, and how
    many words these have."""
    bits = np.uint64(64 - max(10, int(4 * len(spots.n)).bit_length()))

    def frequent(marks: np.ndarray, n: np.ndarray) -> np.ndarray:
        slots = (marks >> bits).astype(np.int64)
        return np.bincount(slots, n)[slots] >= least if len(slots) else np.zeros(0, bool)

    lang, (first, second, third), n = spots.lang, spots.words, spots.n
    mark = spots.mark()
    pair = frequent(mark, n)
    long = np.flatnonzero(pair & (third >= 0))
    more = frequent(_mix(~mark[long] + third[long].astype(np.uint64)), n[long])
    long = long[more]
    at = np.flatnonzero(pair)
    langs, one, head = _dense(lang[at], first[at])
    heads, two, pairs = _dense(head, second[at])
    place = np.zeros(len(lang), np.int64)
    place[at] = pairs
    owners, three, _ = _dense(place[long], third[long])

    def phrase(*words: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*[spots.names.take(pa.array(w)) for w in words], " ")

    own = heads[owners]
    return (spots.langs.take(pa.array(langs[np.concatenate((heads, own))])),
            pa.concat_arrays([phrase(one[heads], two), phrase(one[own], two[owners], three)]),
            np.repeat([2, 3], [len(two), len(three)]))


class Trie:
    """Double-array trie over (language, words). A word is two symbols, the halves of its number,
    so no node has many children. A state is a place in the arrays; the child of state s by symbol
    c is at base[s] + c, and is one if check[] there is s. Places of languages come last."""

    def __init__(self, langs: pa.Array, phrases: pa.Array):
        """Phrases are words joined by spaces; the number of a phrase is its place."""
        split = pc.split_pattern(phrases, " ")
        coded = split.flatten().dictionary_encode()
        self.words = {w.encode(): i for i, w in enumerate(coded.dictionary.to_pylist())}
        self.bits = max(1, (len(self.words).bit_length() + 1) // 2)
        symbols = 1 << self.bits
        ids = coded.indices.to_numpy(zero_copy_only=False)
        begins = split.offsets.to_numpy()[:-1].astype(np.int64)
        begins -= begins[0] if len(begins) else 0
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = langs.dictionary_encode()
        self.langs = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
        # Nodes level by level, (parent, symbol), numbered from the languages on.
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count, parents, own = len(self.langs), [], []
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > k)
            word = ids[begins[live] + k]
            for symbol in (word >> self.bits, word & symbols - 1):
                code, node = np.unique(at[live] << self.bits | symbol, return_inverse=True)
                parents.append((code >> self.bits).astype(np.int32))
                own.append((code & symbols - 1).astype(np.int32))
                at[live] = count + node
                count += len(code)
        none = np.zeros(0, np.int32)
        places = self._lay(np.concatenate([none, *parents]), np.concatenate([none, *own]),
                           len(self.langs), symbols)
        self.size = len(phrases)
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[places[at]] = np.arange(self.size, dtype=np.int32)

    def pack(self) -> bytes:
        """All of a trie; :meth:`unpack` makes it again. Arrays are compressed one by one, so that
        no more than one of them is there twice at a time."""
        arrays = [(zlib.compress(a, 1), len(a)) for a in (self.base, self.check, self.accept)]
        return pickle.dumps((list(self.langs), list(self.words), self.bits, self.roots, self.size,
                             arrays))

    @staticmethod
    def unpack(data: bytes) -> Trie:
        trie = Trie.__new__(Trie)
        langs, words, trie.bits, trie.roots, trie.size, arrays = pickle.loads(data)
        trie.langs = {v: i for i, v in enumerate(langs)}
        trie.words = {w: i for i, w in enumerate(words)}
        trie.base, trie.check, trie.accept = (
            np.frombuffer(zlib.decompress(a, bufsize=4 * n), np.int32) for a, n in arrays)
        return trie

    def _lay(self, parent: np.ndarray, symbol: np.ndarray, roots: int, symbols: int
             ) -> np.ndarray:
        """Give every node a place. Children of one node need a base at which all their places
        are free. Nodes with many children come first; those with about as many try random bases
        together, and of those that collide one goes first. What finds none gets new places."""
        room = max(1024, 5 * len(parent) // 2)
        order = np.argsort(parent, kind="stable")
        heads, first, sizes = np.unique(parent[order], return_index=True, return_counts=True)
        draw = np.random.default_rng(7)
        taken, claim = np.zeros(room + symbols, bool), np.zeros(room + symbols, np.int32)
        base = np.zeros(roots + len(parent), np.int64)
        least = int(sizes.max(initial=0)) + 1
        end = room + symbols
        while least > 1:
            least, high = -(-least // 2), least
            rest = np.flatnonzero((sizes >= least) & (sizes < high))
            for _ in range(200):
                if not len(rest):
                    break
                some, later = np.split(rest, [max(1, room // (8 * least))])
                tries = draw.integers(0, room, len(some))
                which = np.repeat(np.arange(len(some), dtype=np.int32), sizes[some])
                steps = np.arange(len(which)) - np.repeat(
                    np.cumsum(sizes[some]) - sizes[some], sizes[some])
                spots = tries[which] + symbol[order[first[some][which] + steps]]
                claim[spots] = which
                fits = np.bincount(which, taken[spots] | (claim[spots] != which), len(some)) == 0
                taken[spots[fits[which]]] = True
                base[heads[some[fits]]] = tries[fits]
                rest = np.concatenate((some[~fits], later))
            base[heads[rest]] = end + symbols * np.arange(len(rest))
            end += symbols * len(rest)
        places = np.empty(roots + len(parent), np.int64)
        places[:roots] = end + np.arange(roots)
        places[roots:] = base[parent] + symbol
        self.roots = end
        self.base = np.zeros(end + roots, np.int32)
        self.base[places] = base
        self.check = np.full(end + roots, -1, np.int32)
        self.check[places[roots:]] = places[parent]
        return places

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States after one more symbol, -1 where there is none."""
        to = self.base[states] + symbols
        return np.where(self.check[to] == states, to, -1)

    def count(self, text: Text, langs: list[str], totals: np.ndarray) -> None:
        """Add the numbers of accepted phrases at all positions of ``text`` to ``totals``."""
        ids = self.number(text.names)[text.codes]
        own = np.array([self.langs.get(v, -1) for v in langs], np.int64)[text.owner]
        self.add(own, [ids, text.next(ids, 1), text.next(ids, 2)], np.ones(len(ids)), totals)

    def number(self, words: list[bytes]) -> np.ndarray:
        """The trie's numbers of words, -1 for those that it doesn't hold."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))

    def add(self, own: np.ndarray, words: list[np.ndarray], n: np.ndarray, totals: np.ndarray) -> None:
        """Add ``n`` to the ``totals`` of the phrases that begin at each spot. ``own`` and ``words``
        are the trie's numbers of languages and of the three words from there on, -1 for none."""
        at = np.flatnonzero(own >= 0)
        states = self.roots + own[at]
        for some in words:
            word = some[at]
            live = word >= 0
            at, states, word = at[live], states[live], word[live]
            states = self.step(states, word >> self.bits)
            live = states >= 0
            at, states, word = at[live], states[live], word[live]
            states = self.step(states, word & (1 << self.bits) - 1)
            live = states >= 0
            at, states = at[live], states[live]
            found = self.accept[states]
            live = found >= 0
            if live.any():
                totals += np.bincount(found[live], n[at[live]], self.size).astype(np.int64)


def count_part(spots: Spots, least: int, shard: int) -> pa.Table:
    """(lang, phrase, words, f) for the phrases that are at least ``least`` times in ``spots``."""
    langs, phrases, words = candidates(spots, least)
    f = np.zeros(len(words), np.int64)
    for begin in range(0, len(words), shard):
        trie = Trie(langs[begin:begin + shard], phrases[begin:begin + shard])
        own, known = (pc.fill_null(pc.index_in(names, value_set=pa.array(list(numbers)).cast(
            pa.string())), -1).to_numpy().astype(np.int64) for names, numbers in (
                (spots.langs, trie.langs), (spots.names, trie.words)))
        known = np.append(known, -1)  # the last number stands for no word
        trie.add(own[spots.lang], [known[w] for w in spots.words], spots.n, f[begin:begin + shard])
    return pa.table({"lang": langs, "phrase": phrases, "words": pa.array(words, pa.int32()),
                     "f": f}).filter(pa.array(f >= least))


def count_phrases(gathered: DataFrame, least: int, shard: int = _SHARD) -> DataFrame:
    """(lang, phrase, words, f) for all phrases that are at least ``least`` times in the spots of
    :func:`gather`. A trie holds ``shard`` phrases at most; each goes over its own bucket only."""
    def count(table: pa.Table) -> pa.Table:
        give_back()
        spots = Spots.unpack(table)
        del table
        found = [count_part(part, least, shard) for part in spots.parts(_PART)]
        return pa.concat_tables(found)

    return gathered.groupBy("bucket").applyInArrow(
        count, "lang string, phrase string, words int, f long")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: as a is at most l and r, it is no more than 10^6."""
    def exact(c: Column) -> Column:
        return c.cast("decimal(15,0)")

    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * exact(a) * exact(a), exact(l) * exact(r))


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, best: int = 2000,
                 lang: str = "lang", text: str = "text", shard: int = _SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of two or three words per
    language, by score, count and phrase.

    a is the phrase's count, l and r those of its two parts at the cut of lowest score (the first
    such), n the language's words. Phrases with fewer than ``least`` occurrences are no candidates;
    one inside a longer candidate with at least ``inside`` percent of its count is left out. Null
    languages are ``und``; null and empty texts have no words; repeated rows count again; other
    columns are not read; an empty table gives no rows. Counts are exact up to 10^15.
    """
    spark = docs.sparkSession
    own = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    seen = look(own, least)
    words = stage(seen.where("word IS NOT NULL").groupBy("lang", "word").agg(
        F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    bits = spark.sparkContext.broadcast(safe_slots(seen, least))
    buckets = min(1 << SLOT_BITS, 1 + (words.agg(F.sum("f")).first()[0] or 0) // _BUCKET)
    counted = stage(count_phrases(gather(own, bits, buckets), least, shard), "phrases-counted")
    bits.destroy()
    return rank_phrases(counted, words.where(F.col("f") >= least), totals, inside, best)


def rank_phrases(counted: DataFrame, words: DataFrame, totals: DataFrame, inside: int, best: int
                 ) -> DataFrame:
    """Scores of counted pairs and triples, without those inside longer ones, ranked by language."""
    def count_of(rows: DataFrame, phrase: Column, known: DataFrame, out: str) -> DataFrame:
        held = known.select(F.col("lang").alias("_l"), F.col(known.columns[1]).alias("_p"),
                            F.col("f").alias(out))
        return rows.withColumn("_q", phrase).join(
            held, (F.col("lang") == F.col("_l")) & (F.col("_q") == F.col("_p"))).drop(
                "_l", "_p", "_q")

    pairs = counted.where("words = 2").select("lang", "phrase", "f")
    triples = counted.where("words = 3").select("lang", "phrase", "f")
    word = [F.split("phrase", " ")[k] for k in range(3)]
    start, rest = F.concat_ws(" ", word[0], word[1]), F.concat_ws(" ", word[1], word[2])
    two = count_of(count_of(pairs, word[0], words, "l"), word[1], words, "r")
    three = count_of(count_of(triples, word[0], words, "_l1"), rest, pairs, "_r1")
    three = count_of(count_of(three, start, pairs, "_l2"), word[2], words, "_r2")
    a = F.col("f")
    two = two.withColumn("score", _score(a, F.col("l"), F.col("r")))
    three = three.withColumn("_c", F.array_min(F.array(*[F.struct(
        _score(a, F.col(f"_l{k}"), F.col(f"_r{k}")).alias("score"), F.lit(k).alias("k"),
        F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")) for k in (1, 2)])))
    three = three.select("lang", "phrase", "f", "_c.l", "_c.r", "_c.score")
    longer = (triples.select("lang", F.explode(F.array(start, rest)).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("_longer")))
    free = (two.join(longer, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("_longer") < inside * a, F.lit(True))).drop("_longer"))
    ranked, order = free.unionByName(three), [F.desc("score"), F.desc("f"), "phrase"]
    # The best of each part of a language first, so that no task sorts a whole language.
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return (ranked.join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase",
                    F.col("f").alias("a"), "l", "r", "n", "score"))
