"""The resampled documents, their weights and ranks against a word-by-word recomputation."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from swathe.llm import quality
from swathe.llm.queries import QUERIES
from tests.conftest import SF

MASK = 2 ** 64 - 1
ODD, OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def core_of(word):
    begin, end = 0, len(word)
    while begin < end and not (word[begin].isalnum() or word[begin] == "_"):
        begin += 1
    while end > begin and not (word[end - 1].isalnum() or word[end - 1] == "_"):
        end -= 1
    return word[begin:end].lower()


def buckets(text):
    """Every n-gram of a text as (table, bucket), one word after the other."""
    out, previous, before, again_before = [], 0, 0, False
    for i, word in enumerate((text or "").split()):
        core, shape = core_of(word), quality.shape_of(word)
        own = xxhash.xxh3_64_intdigest(core or word) & ~31 & MASK
        again = own == previous and i > 0
        out.append((0, (own * ODD & MASK) >> 44))
        out.append((0, ((own ^ (previous >> 7)) * OTHER & MASK) >> 44))
        kind = (before * 32 + shape) * 3 + again + (again and again_before)
        out.append((0, ((kind + 1) * ODD & MASK) >> 44))
        mixed = 0
        for n, letter in enumerate(core[:8], 1):
            mixed = (mixed ^ ord(letter)) * ODD & MASK
            mixed ^= mixed >> 29
            if n >= 3 and len(core) > n:
                out.append((1, ((mixed + n) * OTHER & MASK) >> 44))
        previous, before, again_before = own, shape, again
    return out


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = quality.labelled_sample(labels, 50_000, "doc_id")
    found = {r.doc_id: buckets(r.text) for r in docs}
    counts = Counter(b for own in found.values() for b in own)
    target = Counter(b for k, own in found.items() if sample.get(k) == (True, True) for b in own)
    totals = [[max(1, sum(n for (t, _), n in c.items() if t == table)) for table in (0, 1)]
              for c in (target, counts)]
    ratios = {}
    for bucket, raw in counts.items():
        table, got = bucket[0], target[bucket]
        expected = raw * (totals[0][table] / totals[1][table])
        beyond = max(0.0, (got - expected) ** 2 / (expected + 1) - 1) ** 2
        ratios[bucket] = float(np.float32(math.log((got + .5) / (expected + .5)) * beyond / (beyond + 81)))
    weights = {k: sum(ratios[b] for b in own) for k, own in found.items()}
    return {r.doc_id: r.text for r in docs}, sample, weights


def test_weights_ranks_and_number_kept(spark, plain):
    texts, sample, weights = plain
    rows = {r.doc_id: r for r in QUERIES["op7_quality"](spark, SF).collect()}
    assert rows and all(abs(r.log_weight - weights[k]) < 1e-3 for k, r in rows.items())
    keys = {}
    for k, t in texts.items():
        draw = xxhash.xxh3_64_intdigest(f"{k}\n{t or ''}", seed=11)
        gumbel = -math.log(-math.log(((draw >> 11) + .5) / 2 ** 53))
        keys[k] = weights[k] + quality.NOISE * gumbel
    held = [(weights[k], good) for k, (good, fitting) in sample.items() if not fitting]
    goods, bads = [w for w, g in held if g], [w for w, g in held if not g]
    order = sorted({w for w, _ in held})
    cuts = [(a + b) / 2 for a, b in zip(order, order[1:])]
    best = max(cuts, key=lambda c: sum(w >= c for w in goods) / len(goods)
               + sum(w < c for w in bads) / len(bads))
    assert abs(len(rows) - sum(w >= best for w in weights.values())) <= 1
    want = sorted(keys, key=lambda k: -keys[k])[:len(rows)]
    got = sorted(rows, key=lambda k: rows[k]["rank"])
    assert all(abs(keys[a] - keys[b]) < 2e-3 for a, b in zip(got, want))
    assert all(abs(r.sample_key - keys[k]) < 1e-3 for k, r in rows.items())
