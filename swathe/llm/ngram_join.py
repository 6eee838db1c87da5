"""Set-similarity join on word n-grams by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct n-grams. The n-grams have one global
order, rarest first; the order is cut into fragments, overlaps are counted within each fragment,
and the counts are summed per pair.

1. One pass over the texts gives every document's set size and set digest, and counts in how many
   documents each n-gram occurs. The n-gram space is cut into ranges, each counted in one task
   from sorted, pre-aggregated pieces. The outcome is a table of fixed size with the frequency
   level of every slot of the n-gram space. It only decides the order, so n-grams that share a
   slot cost work, not links. Level 0 is certain: these n-grams occur once.
2. Documents with equal sets form a class; from here on a class stands for its documents, whatever
   their keys. A second pass gives the rare end of each set (prefix): two sets that link share an
   n-gram there. For sets whose prefix holds an n-gram that may occur elsewhere the same pass gives
   the fragments, so no text is read or moved again.
3. Every class is paired with the most typical class of each n-gram that it shares, which is
   linear in the input however large a group of copies is. Overlaps of these pairs are counted by
   fragment. Links give components.
4. Whatever the order of magnitude of a group, classes that already are in one component need no
   further comparison. All pairs across components that share a prefix n-gram and pass the length
   and position bounds are counted the same way. So no link between components can be missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.llm.components import components
from swathe.llm.tasks import kept, slices, texts_of
from swathe.sources.staging import release, stage

SLOT_BITS = 25      # slots of the frequency table: 32 MB, whatever the input's size
_KEPT_BYTES = 5     # leading bytes of an n-gram's hash that are counted
_EMPTY = b""
_WORDS = 400_000    # words whose hashes a worker remembers
_FETCHES = 4        # jobs in which the driver reads the frequency table


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (public-domain finaliser constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = _WORDS):
        self.limit, self.known = limit, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            known.update((w, digest(w)) for w in set(words) if w not in known)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text.

    Words are what stands between ASCII white space, A-Z in lower case. A text with fewer than
    ``n`` words has its whole sequence as the only n-gram, one without words an empty set.
    """
    table = kept(("words",), WordHashes)
    split = [t.encode().lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = table.of([w for s in split for w in s])
    if not len(words):
        return [words] * len(texts)
    # Hash of the n words from each place on; places less than n before a text's end are left out.
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2 ** 64) for k in range(n)]
    grams = np.zeros(len(words), np.uint64)
    whole = max(0, len(words) - n + 1)
    for k in range(n):
        grams[:whole] += _mix(words[k:k + whole] ^ odd[k])
    grams = _mix(grams)
    ends = np.cumsum(counts)
    sets = []
    for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist())):
        if count >= n:
            sets.append(np.unique(grams[end - count:end - n + 1]))
        elif count:
            short = xxhash.xxh3_64_intdigest(b" ".join(split[i]), seed=n)
            sets.append(np.array([short], np.uint64))
        else:
            sets.append(words[:0])
    return sets


def digest_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else _EMPTY


def _planes(hashes: np.ndarray) -> bytes:
    """Leading bytes of sorted hashes, all first bytes first: they compress well."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT_BYTES].T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(_KEPT_BYTES, -1)
    out = np.zeros(planes.shape[1], np.uint64)
    for plane in planes:
        out = (out << np.uint64(8)) | plane
    return out


def survey(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """Staged rows of two kinds: documents (key, size, digest) and pieces of n-gram counts (part,
    grams, counts)."""
    kind = docs.schema["key"].dataType.simpleString()
    names = ["key", "size", "digest", "part", "grams", "counts"]
    bounds = (np.arange(1, parts, dtype=object) * 2 ** 64 // parts).astype(np.uint64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = gram_sets(texts_of(batch.column("text")), n)
            digests = [digest_of(s) for s in sets]
            rows = len(sets)
            none = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(list(map(len, sets)), pa.int64()),
                 pa.array(digests, pa.binary()), pa.nulls(rows, pa.int32()), none, none], names)
            once = dict(zip(digests, sets))  # copies within the batch count as one
            grams, counts = np.unique(np.concatenate([*once.values()]), return_counts=True)
            counts = np.minimum(counts, 65535).astype("<u2")
            cuts = [0, *np.searchsorted(grams, bounds).tolist(), len(grams)]
            filled = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if filled:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(filled), batch.schema.field("key").type),
                     pa.nulls(len(filled), pa.int64()), pa.nulls(len(filled), pa.binary()),
                     pa.array([p for p, _, _ in filled], pa.int32()),
                     pa.array([_planes(grams[a:b]) for _, a, b in filled], pa.binary()),
                     pa.array([counts[a:b].tobytes() for _, a, b in filled], pa.binary())], names)

    return stage(docs.mapInArrow(
        look, f"key {kind}, size long, digest binary, part int, grams binary, counts binary"),
        "ngram-survey")


def frequency_levels(pieces: DataFrame, parts: int) -> np.ndarray:
    """Level of every slot: 0 if all its n-grams occur once, else 8 log2 of the largest count.

    The driver holds the finished table of 2^SLOT_BITS bytes and nothing else.
    """
    shift = np.uint64(8 * _KEPT_BYTES - SLOT_BITS)

    def count(table: pa.Table) -> pa.Table:
        grams = np.concatenate([_from_planes(g) for g in table.column("grams").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, "<u2") for c in table.column("counts").to_pylist()])
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        sums = np.add.reduceat(counts, starts)
        many = sums > 1
        slots = (grams[starts[many]] >> shift).astype(np.int64)
        levels = np.minimum(8 * np.log2(sums[many]), 255).astype(np.uint8)
        first = int(grams[0] >> shift)
        out = np.zeros(int(grams[-1] >> shift) - first + 1, np.uint8)
        np.maximum.at(out, slots - first, levels)
        packed = zlib.compress(out.tobytes(), 1)
        return pa.table({"first": [first], "levels": pa.array([packed], pa.binary())})

    # All parts are counted at once; the driver then fetches the table in a few jobs, not one per part.
    # Most levels are 0, so its JVM holds far less than the table while it passes it on.
    found = stage(pieces.repartition(parts, "part").groupBy("part")
                  .applyInArrow(count, "first long, levels binary"), "levels")
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    for row in found.coalesce(_FETCHES).toLocalIterator():
        piece = np.frombuffer(zlib.decompress(row["levels"]), np.uint8)
        part = table[row["first"]:row["first"] + len(piece)]
        np.maximum(part, piece, out=part)
    release(found)
    return table


class Order:
    """The global order of n-grams: frequency level, then hash. Travels as a broadcast."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels

    def arrange(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in global order, and the levels."""
        levels = self.levels[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        order = np.argsort(levels, kind="stable")  # the set is sorted by hash
        return grams[order], levels[order]


FRAGMENTS = (9, 17, 33, 256)  # upper levels of the order's fragments; each is cut in two by hash
_SIGNATURE_BITS = 512         # of the largest sets; about one per element below


def signature(grams: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes by slot, as 64-bit words.

    Two signatures of one length differ in no more places than the sets have elements of their
    own. The halves of a signature combined by xor are the one for half as many slots.
    """
    slots = 64
    while slots < min(len(grams), _SIGNATURE_BITS):
        slots *= 2
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def rare_ends(docs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """Staged rows of three kinds, for sets with an n-gram in their prefix that may occur in others:
    (cid, gram, size, pos) per such n-gram, (cid, fragment, grams) per fragment of the global order,
    (cid, sig). cid is the set's digest; n-grams that occur once are left out, as they overlap
    with nothing. Sets that a task sees twice are given once."""
    uppers = np.array(FRAGMENTS)
    names = ["cid", "gram", "size", "pos", "fragment", "grams", "sig"]

    def lists(arrays: list[np.ndarray], rows: int, before: int) -> pa.Array:
        """``arrays`` as the rows from ``before`` on, nulls elsewhere."""
        offsets = np.zeros(rows + 1, np.int32)
        ends = np.cumsum([len(a) for a in arrays])
        offsets[before + 1:before + 1 + len(arrays)] = ends
        offsets[before + 1 + len(arrays):] = ends[-1] if len(ends) else 0
        valid = np.zeros(rows, bool)
        valid[before:before + len(arrays)] = True
        values = np.concatenate([np.zeros(0, np.int64), *arrays])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~valid))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text"):
            own, grams, sizes, places = [], [], [], []
            cut, numbers, parts, signed, sigs = [], [], [], [], []
            for s in gram_sets(texts_of(batch.column("text")), n):
                digest = digest_of(s)
                if not len(s) or digest in seen:
                    continue
                seen.add(digest)
                ordered, levels = order.value.arrange(s)
                length = len(s) - -(-percent * len(s) // 100) + 1
                at = np.flatnonzero(levels[:length])
                if not len(at):
                    continue
                own += [digest] * len(at)
                grams.append(ordered[at].view(np.int64))
                sizes += [len(s)] * len(at)
                places += at.tolist()
                ordered, levels = ordered[levels > 0], levels[levels > 0]
                place = 2 * np.searchsorted(uppers, levels, side="right") + (
                    ordered >> np.uint64(63)).astype(np.int64)
                for f in np.unique(place).tolist():
                    cut.append(digest)
                    numbers.append(f)
                    parts.append(np.sort(ordered[place == f].view(np.int64)))
                signed.append(digest)
                sigs.append(signature(s))
            if own:
                a, b, rows = len(own), len(own) + len(cut), len(own) + len(cut) + len(signed)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own + cut + signed, pa.binary()),
                    pa.concat_arrays([pa.array(np.concatenate(grams)), pa.nulls(rows - a, pa.int64())]),
                    pa.array(sizes + [None] * (rows - a), pa.int32()),
                    pa.array(places + [None] * (rows - a), pa.int32()),
                    pa.array([None] * a + numbers + [None] * (rows - b), pa.int32()),
                    lists(parts, rows, a), lists(sigs, rows, b)], names)

    return stage(docs.select("text").mapInArrow(
        look, "cid binary, gram long, size int, pos int, fragment int, grams array<long>, "
              "sig array<long>"), "rare-ends")


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap with which sets of n and m elements link."""
    return F.ceil(percent * (n + m) / F.lit(float(100 + percent)) - F.lit(1e-9))


def _may_link(percent: int) -> Column:
    n, m = F.col("size"), F.col("size2")
    room = F.least(n - F.col("pos"), m - F.col("pos2"))
    return room >= _needed(n, m, percent)


def _may_overlap(percent: int) -> Column:
    """Whether the signatures leave room for the overlap of a link."""
    def like(own: str, other: str) -> Column:
        half = F.size(own) / 2
        folded = F.zip_with(F.slice(own, F.lit(1), half.cast("int")),
                            F.slice(own, (half + 1).cast("int"), half.cast("int")),
                            lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), folded).otherwise(F.col(own))

    # Sizes that may link are less than a factor of two apart, so one folding is enough.
    differing = F.aggregate(
        F.zip_with(like("sig", "sig2"), like("sig2", "sig"),
                   lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0), lambda total, count: total + count)
    n, m = F.col("size"), F.col("size2")
    return F.coalesce(n + m - differing >= 2 * _needed(n, m, percent), F.lit(True))


def count_links(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, size, size2) that link: partial overlaps by fragment, summed per pair."""
    left = pairs.join(fragments.select(F.col("cid").alias("a"), "fragment",
                                       F.col("grams").alias("_own")), "a")
    both = left.join(fragments.select(F.col("cid").alias("b"), "fragment", "grams"),
                     ["b", "fragment"])
    partial = both.select("a", "b", "size", "size2",
                          F.size(F.array_intersect("_own", "grams")).alias("_part"))
    overlap = F.col("_overlap")
    return (partial.groupBy("a", "b", "size", "size2").agg(F.sum("_part").alias("_overlap"))
            .where(100 * overlap >= percent * (F.col("size") + F.col("size2") - overlap))
            .select("a", "b"))


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Every class with the most typical class of each of its shared n-grams: the one with the
    smallest share of rarer n-grams. At most one pair per row of ``shared``."""
    heads = shared.groupBy("gram").agg(F.min(F.struct(
        (F.col("pos") / F.col("size")).alias("r"), "cid", "size", "pos")).alias("_h"))
    return (shared.join(heads, "gram")
            .select(F.col("cid").alias("a"), F.col("_h.cid").alias("b"), "size", "pos",
                    F.col("_h.size").alias("size2"), F.col("_h.pos").alias("pos2"))
            .where(F.col("a") != F.col("b")).where(_may_link(percent))
            .select("a", "b", "size", "size2").distinct())


def cross_pairs(shared: DataFrame, known: DataFrame, signatures: DataFrame, percent: int,
                step: float = 1.02) -> DataFrame:
    """Pairs across components that share a prefix n-gram and pass the bounds.

    Of two such classes one is outside the n-gram's largest component. Those rows look for
    partners among the sizes that their position leaves possible, by equal (n-gram, size class).
    """
    comp = F.coalesce(F.col("component"), F.col("cid"))
    rows = stage(shared.join(known.withColumnRenamed("node", "cid"), "cid", "left")
                 .select("gram", "cid", "size", "pos", comp.alias("comp")), "postings")
    held = rows.groupBy("gram", "comp").agg(F.count("*").alias("n"))
    major = held.groupBy("gram").agg(
        F.max(F.struct("n", "comp")).alias("_m"), F.count("*").alias("_c")).where("_c > 1")
    open_rows = rows.join(major.select("gram", F.col("_m.comp").alias("major")), "gram").join(
        signatures, "cid")

    def size_class(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / F.log(F.lit(step))).cast("int")

    low = F.ceil(percent * F.col("size") / 100.0 - 1e-9)
    high = F.floor((F.col("size") - F.col("pos")) * (100 + percent) / float(percent)
                   - F.col("size") + 1e-9)
    seekers = (open_rows.where("comp <> major").where(high >= low)
               .withColumn("_class", F.explode(F.sequence(size_class(low), size_class(high)))))
    partners = open_rows.select(
        F.col("gram").alias("gram2"), F.col("cid").alias("cid2"), F.col("size").alias("size2"),
        F.col("pos").alias("pos2"), F.col("comp").alias("comp2"), F.col("major").alias("major2"),
        F.col("sig").alias("sig2"), size_class(F.col("size")).alias("_class2"))
    # Two seekers meet from both sides; one of the two is enough.
    once = (F.col("comp2") == F.col("major2")) | (F.col("cid") < F.col("cid2")) | ~(
        F.floor((F.col("size2") - F.col("pos2")) * (100 + percent) / float(percent)
                - F.col("size2") + 1e-9) >= F.ceil(percent * F.col("size2") / 100.0 - 1e-9))
    return (seekers.join(partners, (F.col("gram") == F.col("gram2"))
                         & (F.col("_class") == F.col("_class2"))
                         & (F.col("comp") != F.col("comp2")) & once & _may_link(percent)
                         & _may_overlap(percent))
            .select(F.col("cid").alias("a"), F.col("cid2").alias("b"), "size", "size2").distinct())


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """``key``, n_shingles (set size), component_id of every row.

    Two rows link when 100 * intersection >= percent * union of their n-gram sets;
    component_id is the smallest key that can be reached by links, the row's own included. Null
    and empty texts have empty sets and link with nothing. Null keys are never the smallest (a
    component of nothing else has a null id); repeated keys are rows of their own; other columns
    are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = survey(own, n, parts)
    rows = stage(seen.where("part IS NULL").select("key", "size", "digest"), "sets")
    levels = frequency_levels(seen.where("part IS NOT NULL").select("part", "grams", "counts"),
                              parts)
    release(seen)
    order = spark.sparkContext.broadcast(Order(levels))

    ends = rare_ends(own, order, n, percent)
    order.destroy()
    postings = stage(ends.where("gram IS NOT NULL").select("gram", "cid", "size", "pos").distinct(),
                     "prefixes")
    several = postings.groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = stage(postings.join(several.select("gram"), "gram", "left_semi"), "shared-prefixes")
    release(postings)
    wanted = shared.select("cid").distinct()
    # A set has one row per fragment, and one without a fragment for its signature.
    parted = stage(ends.where("gram IS NULL").join(wanted, "cid", "left_semi")
                   .select("cid", "fragment", "grams", "sig").dropDuplicates(["cid", "fragment"]),
                   "fragments")
    release(ends)
    fragments = parted.where("fragment IS NOT NULL").select("cid", "fragment", "grams")
    signatures = parted.where("sig IS NOT NULL").select("cid", "sig")

    first = stage(star_pairs(shared, percent), "star-pairs")
    links = stage(count_links(first, fragments, percent), "links")
    found = components(links)
    across = cross_pairs(shared, found, signatures, percent).join(first, ["a", "b"], "left_anti")
    more = stage(count_links(across, fragments, percent), "links")
    if not more.isEmpty():
        # Every node's link to its component says as much as the first links.
        found = components(more.unionByName(found.toDF("a", "b")))
    release(shared, parted, first, links, more)
    classes = rows.where("size > 0").groupBy("digest").agg(F.min("key").alias("first"))

    # The smallest key of every class that is joined with others, or has several rows.
    joined = (classes.join(found.withColumnRenamed("node", "digest"), "digest", "left")
              .select("digest", "first", F.coalesce("component", "digest").alias("component")))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = joined.join(least, "component").select("digest", "component_id")
    return (rows.join(labels, "digest", "left")
            .select(F.col("key").alias(key), F.col("size").alias("n_shingles"),
                    F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key"))
                    .alias("component_id")))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of near copies: the one of the smallest key.

    Rows that repeat a kept key stay with it, as the key names the document. Rows without a key
    stay, unless all of them are copies of documents that have one.
    """
    found = ngram_components(docs, n, percent, key, text)
    kept_keys = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(
        F.col(key).alias("_kept")).distinct()
    return docs.join(kept_keys, docs[key].eqNullSafe(kept_keys["_kept"]), "left_semi")
