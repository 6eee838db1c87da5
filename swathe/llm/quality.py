"""Quality selection by importance resampling of documents.

Two generative models give the weight of a document: hashed n-gram frequencies of target text
(labelled good) and of the raw corpus. N-grams are words, word pairs, pairs of word shapes (with
how often the word just stood there, up to twice), and beginnings of 3 to 8 letters of longer words,
in which the evidence of all words of one stem adds up. The weight is the sum of the log ratios of
all n-grams; each is shrunk by how far chance explains it, so rare n-grams count a little each, long
ordinary texts stay near 0, and it is a document's sum that is tested against the cut.
Every document draws Gumbel noise from its own hash, and the k largest of weight + scale * noise
are kept, which is sampling without replacement in proportion to exp(weight / scale). The scale is
0.25 by default, so this is exp(4 * weight) and close to a threshold at the cut: rows well below the
cut are unwanted, not rare. Scale 1 samples in proportion to the exponentiated weights. k is the number
of documents whose weight reaches the cut that separates labelled rows best.

Raw counts cover all documents. Labels are a bounded, documented sample, half of it for the target
model, the other half for the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.llm.tasks import slices, texts_of
from swathe.operators.ordered import global_rank
from swathe.sources.staging import stage

BUCKET_BITS = 20        # frequencies are tables of 2^20 numbers, whatever the corpus holds:
SIZE = 2 << BUCKET_BITS  # one for words, pairs and shapes, one for beginnings of words
NONE = 1 << BUCKET_BITS  # stands for a beginning that a word does not have; carries no weight
STEMS = range(3, 9)     # letters of a beginning
LABELLED = 50_000       # labelled rows used at most
NOISE = 0.25            # scale of the Gumbel noise
_PIECE = 1 << 14
_STRIP = re.compile(r"^\W+|\W+$")
_ENDINGS = ".,;:!?\"')»”"
TARGET, RAW = 0, 1


def shape_of(word: str, core: str | None = None) -> int:
    """Kind of a raw word: symbols only, capitals, digits, symbols at the end or inside, plain.
    ``core`` is the word without the symbols around it, where the caller has it."""
    if core is None:
        core = _STRIP.sub("", word)
    if not core:
        return 1
    ending = len(word) - len(word.rstrip(_ENDINGS))
    symbols = len(word) - len(core) - ending
    kind = 2 if len(core) > 2 and core.isupper() else 5 if core.isalpha() else (
        3 if any(map(str.isdigit, core)) else 4)
    return kind + 8 * (2 if symbols > 1 or ending > 1 else 1 if ending else 0)


def core_and_shape(word: str) -> tuple[str, int]:
    """The word without the symbols around it, and its shape; letters alone, and letters with one
    mark after them, need no search."""
    if word.isalpha():
        return word, 2 if len(word) > 2 and word.isupper() else 5
    core = word[:-1]
    if word[-1] in _ENDINGS and core.isalpha():
        return core, 10 if len(core) > 2 and core.isupper() else 13
    core = _STRIP.sub("", word)
    return core, shape_of(word, core)


def stems_of(cores: list[str]) -> np.ndarray:
    """Buckets of the beginnings of words that go on after them, ``NONE`` where they do not."""
    width = STEMS.stop
    letters = np.array(cores, f"U{width}").view(np.uint32).reshape(-1, width).astype(np.uint64)
    out = np.full((len(cores), len(STEMS)), NONE, np.int32)
    sums = np.zeros(len(cores), np.uint64)
    for n in range(1, width):
        sums = (sums ^ letters[:, n - 1]) * np.uint64(0x9E3779B97F4A7C15)
        sums ^= sums >> np.uint64(29)
        if n in STEMS:
            bucket = ((sums + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(
                64 - BUCKET_BITS)
            longer = letters[:, n] > 0
            out[longer, n - STEMS.start] = NONE | bucket[longer].astype(np.int32)
    return out


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape and beginnings of every word."""
    found = [core_and_shape(w) for w in words]
    cores = [core.lower() for core, _ in found]
    hashes = np.array([xxhash.xxh3_64_intdigest(core or w) for core, w in zip(cores, words)],
                      np.uint64)
    return hashes & ~np.uint64(31), np.array([s for _, s in found], np.int64), stems_of(cores)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, the number of each word among them, and words per text.
    Words are what ``str.split`` gives; a null text has none."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    words, counts = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    # Space at either end of a text leaves an empty word there.
    filled = pc.not_equal(pc.binary_length(words), 0)
    if len(words) > pc.sum(filled).as_py():
        text = np.repeat(np.arange(len(counts)), counts)
        keep = filled.to_numpy(zero_copy_only=False)
        words, counts = words.filter(filled), np.bincount(text[keep], minlength=len(counts))
    different = words.dictionary_encode()
    return different.dictionary, different.indices.to_numpy(), counts


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts in a row: buckets of word, pair and shape (a row each), number of
    the word, words per text; and the beginnings by number of the word.

    Python meets each different word of the texts once, not each word. What it finds is not kept
    for later texts: looking a word up among hundreds of thousands takes as long as finding it again.
    """
    different, numbers, counts = words_of(texts)
    hashes, shapes, stems = word_features(different.to_numpy(zero_copy_only=False).tolist())
    if not len(numbers):
        return np.zeros((0, 3), np.int64), numbers, counts, stems
    odd = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BUCKET_BITS)
    single = ((hashes * odd) >> shift)[numbers]
    hashes, shapes = hashes[numbers], shapes[numbers]
    first = np.zeros(len(hashes), bool)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    first[starts] = True
    prev = np.concatenate(([np.uint64(0)], hashes[:-1]))
    prev[first] = 0
    before = np.concatenate(([0], shapes[:-1]))
    before[first] = 0
    pair = ((hashes ^ (prev >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)) >> shift
    again = hashes == prev
    shape = ((before * 32 + shapes) * 3 + again + (again & np.concatenate(([False], again[:-1])))
             ).astype(np.uint64)
    shape = ((shape + np.uint64(1)) * odd) >> shift
    return np.stack([single, pair, shape], 1).astype(np.int64), numbers, counts, stems


def _counted(at: np.ndarray, numbers: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """How often each bucket occurs; beginnings are counted once per different word."""
    times = np.bincount(numbers, minlength=len(stems))
    used = np.flatnonzero(times)
    out = np.bincount(stems[used].ravel(), np.repeat(times[used], len(STEMS)), SIZE).astype(np.int64)
    out[:NONE] += np.bincount(at.ravel(), minlength=NONE)
    return out


def labelled_sample(labels: DataFrame, limit: int, key: str) -> dict[object, tuple[bool, bool]]:
    """Up to ``limit`` labelled keys by hash order: (good, for fitting). Good is quality 1, not
    toxic. Null keys or labels do not count; a key with two labels is good if all say so."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = (labels.select(F.col(key).alias("key"), good.alias("good")).dropna()
            .groupBy("key").agg(F.min("good").alias("good"))
            .select("key", "good", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(limit))
    return {r["key"]: (r["good"], r["h"] % 2 == 0) for r in rows.collect()}


def count_ngrams(docs: DataFrame, sample) -> tuple[np.ndarray, np.ndarray]:
    """Target and raw counts per bucket, summed per piece of the tables; the driver gets the two
    finished tables."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sample.value
        tables = np.zeros((2, SIZE), np.int64)
        for batch in slices(batches, "text"):
            at, numbers, counts, stems = features(batch.column("text"))
            tables[RAW] += _counted(at, numbers, stems)
            target = np.array([known.get(k) == (True, True)
                               for k in batch.column("key").to_pylist()], bool)
            if target.any():
                own = np.repeat(target, counts)
                tables[TARGET] += _counted(at[own], numbers[own], stems)
        for kind in (TARGET, RAW):
            pieces = [(b, tables[kind, b:b + _PIECE]) for b in range(0, SIZE, _PIECE)
                      if tables[kind, b:b + _PIECE].any()]
            if pieces:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(pieces), pa.int32()),
                     pa.array([b for b, _ in pieces], pa.int32()),
                     pa.array([c.astype("<i8").tobytes() for _, c in pieces], pa.binary())],
                    ["kind", "first", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(data, "<i8")
                sums[kind, first] = sums[kind, first] + own if (kind, first) in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in sums], pa.int32()),
                 pa.array([f for _, f in sums], pa.int32()),
                 pa.array([c.tobytes() for c in sums.values()], pa.binary())],
                ["kind", "first", "counts"])

    schema = "kind int, first int, counts binary"
    pieces = docs.select("key", "text").mapInArrow(count, schema)
    tables = np.zeros((2, SIZE), np.int64)
    for row in pieces.repartition("kind", "first").mapInArrow(add, schema).toLocalIterator():
        own = np.frombuffer(row["counts"], "<i8")
        tables[row["kind"], row["first"]:row["first"] + len(own)] += own
    return tables[TARGET], tables[RAW]


def log_ratios(target: np.ndarray, raw: np.ndarray, sigmas: float = 3.0) -> np.ndarray:
    """log p_target / p_raw per bucket, shrunk by chance.

    With z the standard deviations between the target count and what the raw model expects, and
    e = max(0, z^2 - 1) what exceeds chance, a ratio keeps e^2 / (e^2 + ``sigmas``^4) of its size:
    next to nothing at 1, half at a little over ``sigmas``, nearly all of it far beyond.
    """
    n, m = max(1, target.sum()), max(1, raw.sum())
    expected = raw * (n / m)
    ratio = np.log((target + 0.5) / (expected + 0.5))
    beyond = np.maximum(0.0, (target - expected) ** 2 / (expected + 1) - 1) ** 2
    return (ratio * beyond / (beyond + sigmas ** 4)).astype(np.float32)


def all_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratios of both tables, each against its own totals; 0 for ``NONE``."""
    parts = [log_ratios(t, r) for t, r in (
        (target[:NONE], raw[:NONE]), (target[NONE + 1:], raw[NONE + 1:]))]
    return np.concatenate((parts[0], np.zeros(1, np.float32), parts[1]))


def best_cut(weights: list[tuple[float, bool]]) -> float:
    """The weight that separates good from bad with the highest balanced accuracy; -inf without
    both kinds. Halfway between the two neighbours."""
    ordered = sorted(weights)
    good = np.array([g for _, g in ordered], bool)
    if good.all() or not good.any():
        return float("-inf")
    values = np.array([w for w, _ in ordered])
    below_bad = np.concatenate(([0], np.cumsum(~good))) / (~good).sum()
    below_good = np.concatenate(([0], np.cumsum(good))) / good.sum()
    fits = np.concatenate(([True], values[1:] > values[:-1], [True]))
    at = int(np.argmax(np.where(fits, below_bad - below_good, -1)))
    if at == 0:
        return float("-inf")
    return float(values[at - 1] + values[min(at, len(values) - 1)]) / 2


def _weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Sum of the log ratios of every text's n-grams; the same for a text in any company."""
    at, numbers, counts, stems = features(texts)
    out = np.zeros(len(texts))
    filled = counts > 0
    if filled.any():
        starts = (np.cumsum(counts) - counts)[filled]
        by_word = ratios[stems].sum(axis=1, dtype=np.float64)
        each = ratios[at].sum(axis=1, dtype=np.float64) + by_word[numbers]
        out[filled] = np.add.reduceat(each, starts)
    return np.round(out, 6)


def _sample_keys(keys: list, texts: list[str], weights: np.ndarray, noise: float, seed: int
                 ) -> np.ndarray:
    """Weights plus Gumbel noise drawn from a hash of key and text."""
    draws = np.array([xxhash.xxh3_64_intdigest(f"{k}\n{t}", seed=seed)
                      for k, t in zip(keys, texts)], np.uint64)
    uniform = ((draws >> np.uint64(11)).astype(np.float64) + 0.5) / 2 ** 53
    return weights - noise * np.log(-np.log(uniform))


def _ranked(docs: DataFrame, labels: DataFrame, limit: int, noise: float, seed: int, key: str,
            text: str):
    """All rows with weight, sample key and rank; the number to keep; the ratios."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    sample = spark.sparkContext.broadcast(labelled_sample(labels, limit, key))
    ratios = spark.sparkContext.broadcast(all_ratios(*count_ngrams(own, sample)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sample.value
        for batch in slices(batches, "text"):
            keys, texts = batch.column("key").to_pylist(), texts_of(batch.column("text"))
            weights = _weights(batch.column("text"), ratios.value)
            labels_of = [known.get(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(weights),
                 pa.array(_sample_keys(keys, texts, weights, noise, seed)),
                 pa.array([x[0] if x and not x[1] else None for x in labels_of], pa.bool_())],
                ["key", "log_weight", "sample_key", "good"])

    weighed = stage(own.mapInArrow(
        weigh, f"key {kind}, log_weight double, sample_key double, good boolean"), "weights")
    # At most ``limit`` keys; repeated rows count once.
    held = (weighed.where("good IS NOT NULL").groupBy("key")
            .agg(F.min("log_weight"), F.min("good")).collect())
    cut = best_cut([(r[1], r[2]) for r in held])
    k = weighed.where(F.col("log_weight") >= cut).count()
    ranked = global_rank(weighed.select("key", "log_weight", "sample_key",
                                        (-F.col("sample_key")).alias("_order")),
                         ["_order", "key"])
    return ranked, k, ratios


def resample(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, noise: float = NOISE,
             seed: int = 11, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept documents: ``key``, log_weight, sample_key, rank.

    One row per kept row of ``docs``. Null and empty texts have weight 0; rows with a null or
    repeated key are weighed each by itself; without usable labels all are kept; an empty table
    gives no rows. Copies of a row draw the same noise and stand or fall together but for the last
    rank. Two passes over the texts; what is shuffled is one table of counts per task and a narrow
    row per document.
    """
    ranked, k, _ = _ranked(docs, labels, limit, noise, seed, key, text)
    return (ranked.where(F.col("rank") <= k)
            .select(F.col("key").alias(key), "log_weight", "sample_key", "rank"))


def keep_resampled(docs: DataFrame, labels: DataFrame, limit: int = LABELLED,
                   noise: float = NOISE, seed: int = 11, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps, with all their columns.

    Rows are weighed again and compared with the last kept sample key, so the texts are not
    shuffled and rows without a key can stay; rows that tie with the last one stay too.
    """
    ranked, k, ratios = _ranked(docs, labels, limit, noise, seed, key, text)
    last = ranked.where(F.col("rank") == k).select("sample_key").first() if k else None
    if last is None:
        return docs.limit(0)
    least = last["sample_key"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = _sample_keys(batch.column(key).to_pylist(), texts_of(batch.column(text)),
                                 _weights(batch.column(text), ratios.value), noise, seed)
            yield batch.filter(pa.array(found >= least))

    return docs.mapInArrow(keep, docs.schema)
