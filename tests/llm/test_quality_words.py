"""Words of texts as quality selection counts them: whole, and each different one looked at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from swathe.llm import quality
from tests.llm.test_quality_plain import buckets, core_of

ODD = [None, "", " \t\n", " one", "one ", " one\x1c two\x85　", "--- ... _ _a_ $$$",
       "THE The the, the. (the) the!? ABC ABC, AB Ab3 3,14 x²", "ΟΔΟΣ ΟΔΟΣ. ΣΑΣ' Σⓐ İstanbul ǅ",
       "\x01 a\x01b", "word " * 5000, "word" * 20_000, "same same same same other same",
       "straße Straßen élève, élèves. ÉLÈVE! 中文字符很多的词 中文", "ábc don't semi-final x_y"]


def test_python_meets_each_different_word_once(monkeypatch):
    met = []
    plain = quality.word_features
    monkeypatch.setattr(quality, "word_features", lambda words: met.extend(words) or plain(words))
    texts = ["the cat and the dog and the cow"] * 500 + ["the end", None, ""]
    at, numbers, counts, stems = quality.features(pa.array(texts))
    assert sorted(met) == ["and", "cat", "cow", "dog", "end", "the"]
    assert len(at) == len(numbers) == counts.sum() == 4002 and len(stems) == 6
    assert counts.tolist() == [8] * 500 + [2, 0, 0]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_weights_and_counts_of_odd_texts(kind):
    ratios = np.random.default_rng(5).normal(size=quality.SIZE).astype(np.float32)
    ratios[quality.NONE] = 0
    places = [[table << quality.BUCKET_BITS | bucket for table, bucket in buckets(t)] for t in ODD]
    want = [float(ratios[p].sum(dtype=np.float64)) if p else 0.0 for p in places]
    column = pa.array(["before", *ODD, "after"], kind).slice(1, len(ODD))
    assert np.allclose(quality._weights(column, ratios), want, atol=1e-5, rtol=1e-9)
    alone = [quality._weights(pa.array([t], kind), ratios)[0] for t in ODD]
    assert alone == quality._weights(column, ratios).tolist()
    at, numbers, counts, stems = quality.features(column)
    assert counts.tolist() == [len((t or "").split()) for t in ODD]
    counted = quality._counted(at, numbers, stems)
    plain = np.bincount([b for p in places for b in p], minlength=quality.SIZE)
    # Bucket ``NONE`` also takes the beginnings that words do not have.
    counted[quality.NONE] = plain[quality.NONE] = 0
    assert np.array_equal(counted, plain)


def test_words_are_split_as_python_does_at_every_code_point():
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    words, numbers, counts = quality.words_of(pa.array(texts))
    split = [t.split() for t in texts]
    assert counts.tolist() == [len(s) for s in split]
    found = words.to_numpy(zero_copy_only=False)[numbers]
    assert found.tolist() == [w for s in split for w in s]


def test_core_and_shape_without_search():
    letters = "aZ3._,;)”$²é"
    words = [a + b + c + d for a in letters for b in letters for c in ["", *letters]
             for d in ["", *letters]]
    for word in words:
        core, shape = quality.core_and_shape(word)
        assert core.lower() == core_of(word) and shape == quality.shape_of(word)
