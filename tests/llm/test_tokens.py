"""Token counts, token files and packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swathe.llm.packing import first_fit_decreasing, pack_documents
from swathe.llm.token_counts import MergeCounts, merged_length, token_counts
from swathe.llm.token_files import read_token_files, write_token_files
from swathe.llm.tokens import VOCABULARY, library_table

PATH = public_tokenizers.path(VOCABULARY)
ODD = (None, "", " ", "  ", "a  b", "a   b", "a \n b\n\n", "x\n", "<|endoftext|>", "a\n <|endoftext|> b",
       "it's 'll", "naïve   \nⅧ²", "日本語 テキスト", "b" * 30_000, " " * 5_000, "a,.\n.b.")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def docs(spark):
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(3, "  ", 1), (None, "no key", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)


def test_tables_equal_the_library(library):
    draw = random.Random(5)
    parts = [*" \n\t.,;'s|!é日² 　aXb1", "<|endoftext|>", "  ", " \n", "word.", "foo", "re's"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 24))) for _ in range(4_000)]
    texts += [t for t in ODD if t]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert MergeCounts(PATH).totals(texts).tolist() == list(map(len, want))
    ids, counts = library_table().ids(texts)
    assert counts.tolist() == list(map(len, want))
    assert ids.tolist() == [i for x in want for i in x]


def test_full_tables_start_anew(library):
    table = MergeCounts(PATH, limit=5)
    texts = ["one two three four five six seven", "eight nine ten"]
    for _ in range(3):
        assert [int(table.totals([t])[0]) for t in texts] == [
            len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_merging_takes_the_leftmost_of_equal_pairs():
    assert merged_length(list("aaaaa"), {("a", "a"): 0}) == 3
    assert merged_length(list("abc"), {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}) == 1
    assert merged_length([], {}) == 0


def test_token_counts(docs, library):
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in token_counts(docs).collect() if r.doc_id is not None)
    want = []
    for i, t in [*enumerate(ODD), (3, "  ")]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((False, i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


@pytest.mark.parametrize("length", [4, 2048])
def test_token_files_round_trip(docs, library, length):
    index = write_token_files(docs, length=length)
    rows = sorted(read_token_files(index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows][0] is None  # null keys first
    start = 0
    for r in rows:
        text = "no key" if r.doc_id is None else ODD[r.doc_id]
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert (r.start, r.n_tokens) == (start, len(want))
        start += len(want)
    assert [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    one = read_token_files(index.where("doc_id = 13")).first()  # random access
    assert one.n_tokens == len(library.encode(ODD[13], add_special_tokens=False).ids) + 1


def test_first_fit_decreasing_equals_the_plain_loop():
    draw = random.Random(3)
    for n in (0, 1, 2, 7, 100):
        sizes = [draw.randint(1, 50) for _ in range(n)]
        free, want = [], [None] * n
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b = next((b for b, room in enumerate(free) if room >= sizes[i]), len(free))
            if b == len(free):
                free.append(50)
            want[i] = (b, 50 - free[b])
            free[b] -= sizes[i]
        assert first_fit_decreasing(sizes, 50) == want


def test_packing_covers_every_id_once(docs, library):
    rows = pack_documents(docs, length=64, group_docs=5).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for (key, total), pieces in by_doc.items():
        text = "no key" if key is None else ODD[key]
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        copies = 2 if key == 3 else 1
        assert len(want) == total and sum(r.length for r in pieces) == copies * total
        for r in pieces:
            assert np.frombuffer(r.ids, "<u4").tolist() == want[r.start:r.start + r.length]
    crc = pack_documents(docs).where("doc_id = 0").select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32(np.array([1], "<u4").tobytes())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(empty).count() == 0
    assert pack_documents(empty).count() == 0
    assert read_token_files(write_token_files(empty)).count() == 0


def test_a_task_gives_back_what_earlier_ones_freed():
    """Blocks below the allocator's threshold, freed under one that is still held."""
    import numpy as np
    import pyarrow as pa

    from swathe.llm.tasks import slices

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    blocks = [np.ones(12_500) for _ in range(2000)]
    last, high = blocks[-1], resident()
    del blocks
    batch = pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"])
    assert len(list(slices(iter([batch]), "text"))) == 1 and last[0] == 1
    assert resident() < high - 150
