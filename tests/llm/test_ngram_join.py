"""N-gram join and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from swathe.llm import ngram_join
from swathe.llm.components import components
from swathe.llm.ngram_join import keep_first, ngram_components, signature

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_force(rows, n, percent):
    """Smallest reachable key per position in ``rows``."""
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                label[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    least = {}
    for members in groups.values():
        keys = [rows[i][0] for i in members if rows[i][0] is not None]
        least.update((i, min(keys, default=None)) for i in members)
    return [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choices(words, k=90) for _ in range(6)]
    shared = draw.choices(words, k=40)  # a passage in many unlike texts
    texts = []
    for i in range(150):  # one large group of near copies, several small ones, a chain
        own = list(base[0 if i % 3 else draw.randrange(6)])
        for _ in range(draw.randint(0, 4)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10_000)}"
        texts.append(" ".join(own))
    chain = draw.choices(words, k=100)
    for i in range(12):
        texts.append(" ".join(chain[i * 3:] + [f"y{k}" for k in range(i * 3)]))
    texts += [" ".join(draw.choices(words, k=60) + shared) for _ in range(40)]
    texts += [texts[0]] * 20 + [texts[5].upper()] + ["one two", "One  two", "one", "", " \n", None]
    texts.append("ß É é   x " * 20)
    texts.append("long " * 20_000)
    keys = list(range(1, len(texts) + 1))
    draw.shuffle(keys)
    data = list(zip(keys, texts))
    # Two unlike texts that only one without a key links.
    bridge = draw.choices(words, k=120)
    ends = [bridge[:-4] + [f"q{i}" for i in range(4)], [f"p{i}" for i in range(4)] + bridge[4:]]
    data += [(9001, " ".join(ends[0])), (None, " ".join(bridge)), (9002, " ".join(ends[1]))]
    return data + [(None, texts[0]), (None, "nobody else says this at all"), data[3], data[3]]


def test_bridge_without_a_key(rows):
    found = {k: c for k, _, c in brute_force(rows, 4, 85)}
    assert found[9002] == found[9001] == 9001  # the test below holds such a case


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, rows, n, percent):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA).repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df, n, percent).collect()]
    assert order(got) == order(brute_force(rows, n, percent))


def test_keep_first_leaves_one_of_each_group(spark, rows):
    data = [(k, t, "x") for k, t in dict((r[0], r) for r in rows if r[0] is not None).values()]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.doc_id for r in keep_first(df).collect()}
    want = {least for _, _, least in brute_force([r[:2] for r in data], 5, 80)}
    assert got == want and keep_first(df).columns == df.columns


def test_signatures_bound_the_overlap():
    """No pair that links is ever ruled out, and most others are."""
    draw = np.random.default_rng(4)
    out = 0
    for _ in range(400):
        size = int(draw.integers(1, 900))
        a = np.unique(draw.integers(0, 2 ** 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate((a[draw.random(len(a)) < draw.choice([0.5, 0.8, 0.95, 1.0])],
                                      draw.integers(0, 2 ** 63, int(size * draw.choice([0, 0.1, 0.5])),
                                                    dtype=np.uint64))))
        if not 0.8 <= len(a) / max(1, len(b)) <= 1.25:
            continue
        x, y = signature(a), signature(b)
        x = x[:len(y)] ^ x[len(y):] if len(x) > len(y) else x
        y = y[:len(x)] ^ y[len(x):] if len(y) > len(x) else y
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64).tolist())
        assert differ <= len(np.setxor1d(a, b))
        out += 100 * (len(a) + len(b) - differ) // 2 < 85 * (len(a) + len(b) + differ) // 2
    assert out > 60


def test_texts_of_shared_passages_make_few_pairs(spark, monkeypatch):
    """Twice the texts made of a fixed stock of passages, none of which link: no four times the
    pairs are counted."""
    draw, counted = random.Random(8), []
    stock = [" ".join(f"s{p}w{draw.randrange(500)}" for _ in range(40)) for p in range(30)]
    plain = ngram_join.count_links
    monkeypatch.setattr(ngram_join, "count_links", lambda pairs, *rest: (
        counted.append(pairs.count()), plain(pairs, *rest))[1])
    for n in (150, 300):
        data = [(i, " ".join(draw.sample(stock, 4)), "x") for i in range(n)]
        found = ngram_components(spark.createDataFrame(data, SCHEMA)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(
            brute_force([r[:2] for r in data], 4, 85))
    assert sum(counted[2:]) <= 3 * 300


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("counted", "")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_frequency_levels_take_few_jobs_and_pass_little(spark):
    """The driver's jobs do not grow with the parts, and no part is sent as long as its slots are."""
    draw, sent = np.random.default_rng(5), []
    grams = np.unique(draw.integers(0, 2 ** 64, 4000, dtype=np.uint64))
    counts = draw.integers(1, 4, len(grams))
    parts = 40
    bounds = (np.arange(1, parts, dtype=object) * 2 ** 64 // parts).astype(np.uint64)
    cuts = [0, *np.searchsorted(grams, bounds).tolist(), len(grams)]
    data = [(p, bytearray(ngram_join._planes(grams[a:b])), bytearray(counts[a:b].astype("<u2").tobytes()))
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])) for _ in range(2)]
    pieces = spark.createDataFrame(data, "part int, grams binary, counts binary").cache()
    pieces.count()
    plain = ngram_join.stage
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join, "stage", lambda df, name: (
            sent.append(plain(df, "seen")), plain(sent[-1], name))[1])
        ngram_join.frequency_levels(pieces, parts)
    levels, jobs = jobs_of(spark, lambda: ngram_join.frequency_levels(pieces, parts))
    want = np.zeros(1 << ngram_join.SLOT_BITS, np.uint8)
    np.maximum.at(want, (grams >> np.uint64(64 - ngram_join.SLOT_BITS)).astype(np.int64),
                  (8 * np.log2(2 * counts)).astype(np.uint8))
    assert (levels == want).all()
    assert jobs < 20
    assert sum(len(r["levels"]) for r in sent[0].collect()) < (1 << ngram_join.SLOT_BITS) / 20


def test_components_are_found_once_without_links_across(spark, monkeypatch):
    """No second search where the first round of pairs has found every link."""
    calls, plain = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda links: (
        calls.append(links.count()), plain(links))[1])
    data = [(i, " ".join(f"t{i // 3}w{k}" for k in range(50)) + f" e{i}", "x") for i in range(30)]
    found = ngram_components(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(
        brute_force([r[:2] for r in data], 4, 85))
    assert len(calls) == 1


def test_links_across_join_components(spark, rows, monkeypatch):
    """Links that only the second round of pairs finds count like those of the first."""
    calls, plain = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda links: (
        calls.append(links.count()), plain(links))[1])
    few = ngram_join.star_pairs
    monkeypatch.setattr(ngram_join, "star_pairs", lambda shared, percent: few(shared, percent).where(
        "crc32(a) % 3 = 0"))
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df).collect()]
    assert order(got) == order(brute_force(rows, 4, 85))
    assert len(calls) == 2


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_components(empty).count() == 0 and keep_first(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [
        (7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)},
                     200: 200, 201: 200}
