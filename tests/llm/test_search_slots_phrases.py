"""Lexical search, sharding and collocations against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swathe.llm import collocations as phrases
from swathe.llm import lexical, slots
from swathe.llm.collocations import collocations
from swathe.llm.lexical import rank_documents
from swathe.llm.queries import QUERIES
from swathe.llm.slots import shard_documents
from swathe.sources.staging import staging_path
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, rank string, score string, size string, item string"


def table(spark, rows):
    """Documents with more columns whose names the results use too."""
    return spark.createDataFrame([(k, t, v, "x", "y", "z", "w") for k, t, v in rows], DOCS)


# Lexical search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [t.encode().lower() for t in TERM.findall(text or "")]


def plain_ranking(docs, items, top):
    split = [(k, plain_terms(t)) for k, t, _ in docs]
    count = sum(bool(t) for _, t in split)
    words = sum(len(t) for _, t in split)
    frequency = Counter(t for _, terms in split for t in set(terms))
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        found = []
        for key, terms in split:
            tf, score = Counter(terms), 0
            for t in plain_terms(text):
                if tf[t]:
                    m = 100 - 75 + (75 * len(terms) * count) // words
                    w = floor(1000 * log((2 * count + 2) / (2 * frequency[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        found.sort(key=lambda f: f[:3])
        out += [(item, i, f[3], -f[0]) for i, f in enumerate(found[:top], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["ÉTÉ", "été", "naïve", "42", "x_y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = []
    for i in range(300):
        text = draw.choice([" ", ", ", "\t-"]).join(draw.choices(words, weights, k=draw.randint(1, 60)))
        docs.append((i // 2, text if i % 3 else text.upper(), draw.choice(["en", "de", None])))
    docs += [(None, docs[7][1], None), (7, None, "en"), (8, "", "de"), (9, " .\n", "en")]
    docs += [(500 + i, docs[3][1], "en") for i in range(40)]  # ties
    docs.append((900, " ".join(draw.choices(words, weights, k=30_000)), "en"))
    return docs


def test_ranking(spark, prose, monkeypatch):
    monkeypatch.setattr(lexical, "_GROUP", 64)  # several trees in a task
    draw = random.Random(6)
    items = [(i, " ".join(draw.choices(prose[draw.randrange(300)][1].split() or ["w1"], k=12)))
             for i in range(25)]
    items += [(3, "w1 w1 W1 été ÉTÉ"), (None, "w59 w58"), (30, None), (31, ""), (32, "nothing"),
              (0, items[0][1])]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = order(plain_ranking(prose, items, 10))
    for block in (20_000, 7):
        got = rank_documents(table(spark, prose), asked, block=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        rows = got.collect()
        # The item that is there twice is one; two texts of one id are ranked by themselves.
        assert order(tuple(r) for r in rows) == want
    none = rank_documents(table(spark, prose).limit(0), asked)
    assert none.count() == 0 and rank_documents(table(spark, prose), asked.limit(0)).count() == 0


def test_tree_bounds_and_prunes():
    """A node's bound is no less than any score below it; where some documents hold the whole item,
    most others are never scored."""
    draw = np.random.default_rng(3)
    asked = sorted(draw.choice(400, 15, replace=False).tolist())
    vectors = [np.sort(draw.choice(400, s, replace=False)) for s in draw.integers(1, 30, 2985)]
    vectors += [np.union1d(asked, draw.choice(400, 5)) for _ in range(15)]
    draw.shuffle(vectors)
    sizes, ranks = np.array(list(map(len, vectors))), np.concatenate(vectors)
    counts, m = draw.integers(1, 9, len(ranks)), draw.integers(25, 400, len(sizes))
    tree = lexical.DocumentTree(list(range(3000)), m, sizes, ranks, counts, 400)
    weights = draw.integers(1, 9000, 15).tolist()
    dense = np.zeros(400, np.int64)
    dense[asked] = weights
    scores = np.add.reduceat(dense[tree.ranks] * tree.adds, tree.begins[:-1])
    bounds = tree.bounds(asked, weights)
    assert all(bounds[i] >= scores[a:b].max() for i, (a, b, _) in enumerate(tree.nodes))
    assert sorted(x for span in tree.leaves.values() for x in range(*span)) == list(range(3000))
    best = []
    dense[:] = 0
    tree.search(asked, weights, dense, best, 10)
    assert not dense.any()
    want = sorted((-int(s), False, k) for s, k in zip(scores, tree.keys) if s)[:10]
    assert best == want
    reach = sum(b - a for i, (a, b) in tree.leaves.items() if bounds[i] >= -best[-1][0])
    assert reach < 900


# Sharding


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op12_slot_shards"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    held = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.law == "bytes" and r.grown_shard is None
        held.setdefault(r.shard, []).append(r)
    assert sorted(held) == list(range(8))
    for own in held.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sums = [sum(r.size for r in own) for own in held.values()]
    assert max(sums) <= 1.01 * sum(sums) / 8


def test_shards_of_odd_rows(spark):
    """Null keys and texts, a record that holds half of all bytes, empty tables."""
    rows = [(i, "t" * (i % 90), "en") for i in range(3000)] + [(None, None, None), (5, None, "en")]
    rows += [(7, "same " * 30, "en")] * 1200
    got = shard_documents(table(spark, rows), 8, slots=512).collect()
    assert len(got) == len(rows)
    sums, places = Counter(), {}
    for r in got:
        sums[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.place)
    assert max(sums.values()) <= 1.02 * sum(sums.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert shard_documents(table(spark, rows).limit(0), 8).count() == 0


def test_map_versions(spark):
    """A stored map is edited: few slots move, and only those that have to."""
    path = staging_path(spark, "test-map")
    docs = spark.createDataFrame([(i, "x" * (i % 700)) for i in range(4000)],
                                 "doc_id long, text string")
    first = shard_documents(docs, 8, 256, path).collect()
    again = shard_documents(docs, 8, 256, path).collect()
    assert slots.newest_version(spark, path) == 1 and sorted(first) == sorted(again)
    grown = {r.doc_id: r for r in shard_documents(docs, 9, 256, path).collect()}
    assert slots.newest_version(spark, path) == 2
    moved = [r for r in first if grown[r.doc_id].shard != r.shard]
    size, new = sum(r.size for r in first), [r for r in moved if grown[r.doc_id].shard == 8]
    assert 0.08 * size <= sum(r.size for r in new) <= sum(r.size for r in moved) <= 0.13 * size
    assert sum(r.size for r in new) >= 0.9 * sum(r.size for r in moved)
    fewer = shard_documents(docs, 6, 256, path).collect()
    stay = [r for r in fewer if grown[r.doc_id].shard < 6]
    assert all(grown[r.doc_id].shard == r.shard for r in stay)
    sums = Counter()
    for r in fewer:
        sums[r.shard] += r.size
    assert set(sums) == set(range(6)) and max(sums.values()) <= 1.04 * size / 6
    before, after = slots.load_map(spark, path, 1), slots.load_map(spark, path, 2)
    assert before.count() == after.count() == 256
    assert slots.moved_slots(before, after).count() < 64
    with pytest.raises(Exception, match="already exists"):
        slots.store_map(after, path, 2)


def test_only_builtin_functions(spark):
    plan = shard_documents(table(spark, [(1, "a", "en")]), 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "ExistingRDD" not in plan


# Collocations


def plain_phrases(docs, least, inside, best):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\n-\r]", (text or "").encode().lower()):
            words = [w.decode() for w in re.findall(rb"[^ \t]+", piece)]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    kept = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longest = {}
    for p, a in kept.items():
        if len(p) == 4:
            for q in (p[:3], (p[0], *p[2:])):
                longest[q] = max(longest.get(q, 0), a)
    ranked = {}
    for p, a in kept.items():
        if p not in longest or 100 * longest[p] < inside * a:
            cuts = [(p[:k + 1], (p[0], *p[k + 1:])) for k in range(1, len(p) - 1)]
            score, _, l, r = min((1000000 * a * a // (f[x] * f[y]), k, f[x], f[y])
                                 for k, (x, y) in enumerate(cuts))
            ranked.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in ranked.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(own)[:best], 1))


@pytest.fixture(scope="module")
def talk():
    draw = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "ab\x0bcd", "new", "york", "city", "a;b"]
    docs = []
    for i in range(400):
        text = ""
        for _ in range(draw.randint(0, 30)):
            text += draw.choice(words[:draw.choice([5, 47])]) + draw.choice(
                [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"])
            if draw.random() < 0.1:
                text += draw.choice(["New York city ", "new york CITY, ", "york new "])
        docs.append((i, text, draw.choice(["en", "en", "de", None, ""])))
    docs += [(None, None, "en"), (1, "", "de"), (2, "..,", None), docs[0], docs[0]]
    docs.append((3, "new york city " * 20_000, "en"))
    docs.append((4, "w" * 100_000, "en"))
    return docs


def test_collocations(spark, talk):
    for shard, best in ((1_000_000, 2000), (60, 25)):
        got = collocations(table(spark, talk), shard=shard, best=best)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_phrases(talk, 10, 50, best)
    assert collocations(table(spark, talk).limit(0)).count() == 0
    assert collocations(table(spark, [(1, "a b", "en")])).count() == 0


def test_texts_are_read_twice_for_any_number_of_tries(spark, talk, monkeypatch):
    """Spots are dealt to buckets, each with tries of its own, however many there are."""
    for name, value in (("_BUCKET", 5000), ("_HELD", 3000), ("_MOST", 900), ("_PART", 300),
                        ("_WORDS", 30), ("_ROWS", 2000), ("_PARTS", 3)):
        monkeypatch.setattr(phrases, name, value)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = table(spark, talk).repartition(5)
    got = collocations(docs.mapInArrow(seen, docs.schema), shard=7, best=25).collect()
    assert sorted(map(tuple, got)) == plain_phrases(talk, 10, 50, 25)
    assert read.value == 2 * len(talk)


def test_spots_are_merged():
    draw = np.random.default_rng(4)
    lang, n = draw.integers(0, 3, 5000), draw.integers(1, 9, 5000)
    words = [draw.integers(0, 12, 5000) for _ in range(2)] + [draw.integers(-1, 12, 5000)]
    want = Counter()
    for *key, count in zip(lang.tolist(), *(w.tolist() for w in words), n.tolist()):
        want[tuple(key)] += count
    langs, found, sums = phrases.merged(lang, words, n)
    assert dict(zip(zip(langs.tolist(), *(w.tolist() for w in found)), sums.tolist())) == want
    assert len(sums) == len(want)


def test_score_beyond_64_bits(spark):
    a, l, r = 3 * 10 ** 12 + 7, 4 * 10 ** 12 + 1, 5 * 10 ** 12 + 3
    row = spark.range(1).select(phrases._score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first()
    assert row.s == 1000000 * a * a // (l * r)


def test_trie_counts_what_is_there():
    draw = random.Random(2)
    words = [f"v{i}" for i in range(900)]
    some = sorted({(draw.choice(["en", "de"]), " ".join(draw.choices(words, k=draw.choice([2, 3]))))
                   for _ in range(4000)}
                  | {("en", f"v0 {w}") for w in words})  # one node with very many children
    trie = phrases.Trie(pa.array([v for v, _ in some]), pa.array([p for _, p in some]))
    texts = [". ".join(p for _, p in draw.choices(some, k=50)) for _ in range(40)]
    langs = [draw.choice(["en", "de", "fr"]) for _ in texts]
    trie = phrases.Trie.unpack(trie.pack())
    totals = np.zeros(trie.size, np.int64)
    trie.count(phrases.Text(texts), langs, totals)
    want = Counter()
    for text, lang in zip(texts, langs):
        for piece in text.split(". "):
            w = piece.split()
            want.update((lang, " ".join(w[i:i + k])) for k in (2, 3) for i in range(len(w) - k + 1))
    assert totals.tolist() == [want[key] for key in some]


def test_unpacking_a_trie_holds_it_once():
    """A worker that unpacks a trie holds no second copy of its arrays."""
    import tracemalloc

    draw = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    some = sorted({" ".join(draw.choices(words, k=draw.choice((2, 3)))) for _ in range(60_000)})
    trie = phrases.Trie(pa.array(["en"] * len(some)), pa.array(some))
    data = trie.pack()
    tracemalloc.start()
    again = phrases.Trie.unpack(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(getattr(trie, n), getattr(again, n)) for n in ("base", "check", "accept"))
    assert again.words == trie.words and again.size == trie.size
    assert peak < 1.7 * sum(getattr(trie, n).nbytes for n in ("base", "check", "accept"))
