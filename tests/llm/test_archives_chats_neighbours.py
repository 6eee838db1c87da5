"""Archives, chats and nearest neighbours."""

from __future__ import annotations

import gzip
import hashlib
import random

import numpy as np
import pytest

from swathe.llm import chat, neighbours
from swathe.llm.neighbours import nearest
from swathe.llm.tasks import filesystem
from swathe.llm.warc import normalise_archives, read_records, write_archives
from swathe.sources.staging import staging_path
from tests.conftest import SF

PAGES = [(1, "http://a/", "x" * 100, 0), (2, None, "x" * 100, 0), (3, "http://b/ c\r\nd", "x" * 99, 0),
         (4, "http://c/", "x" * 99, 0), (5, "é", "é" * 50, 0), (6, "u", "é" * 50, 0), (7, "u", None, 0),
         (8, "u", "", 0), (9, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 9, 0), (10, "u", "long " * 300_000, 0),
         (2, None, "x" * 100, 0), (1, "http://a/", "x" * 100, 0), (None, "u", "x" * 100, 0)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int").repartition(3)


def test_archives_round_trip(pages):
    archives = write_archives(pages)
    index = normalise_archives(archives)
    rows = read_records(index).collect()
    assert len(rows) == len(PAGES) == sum(r.records for r in archives.collect())
    got = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes,
                  r.payload_digest.removeprefix("sha256:")) for r in rows)
    want = []
    for key, _, html, _ in PAGES:
        data = (html or "").encode()
        first = min((k for k, _, h, _ in PAGES if h == html and k is not None), default=None)
        again = len(data) >= 100 and key != first
        want.append((f"<urn:record:{'' if key is None else key}>", "revisit" if again else "response",
                     f"<urn:record:{first}>" if again else "", len(data),
                     hashlib.sha256(data).hexdigest()))
    assert got == sorted(want)
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest.removeprefix("sha256:")
        else:
            assert r.payload is None


def test_members_stand_alone_and_match_the_stream(pages):
    archives = write_archives(pages)
    index = normalise_archives(archives)
    by_file = {}
    for r in index.collect():
        by_file.setdefault(r.file, []).append(r)
    whole = []
    for file, rows in by_file.items():
        files, path = filesystem(file)
        with files.open_input_file(path) as f:
            data = f.read()
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0] + [r.length for r in rows[:-1]]))
        assert sum(r.length for r in rows) == len(data)
        text = b"".join(gzip.decompress(data[r.offset:r.offset + r.length]) for r in rows)
        assert text == gzip.decompress(data)
        with files.open_input_file(path + ".idx") as f:
            assert len(f.read().decode().splitlines()) == len(rows)
        whole.append(text)
    streams = []
    for r in archives.collect():
        files, path = filesystem(r.archive)
        with files.open_input_file(path) as f:
            streams.append(gzip.decompress(f.read()))
    assert sorted(whole) == sorted(streams)
    # Normalising what is normal already changes nothing but the file names.
    spark = pages.sparkSession
    again = normalise_archives(spark.createDataFrame([(f,) for f in by_file], "archive string"))
    assert sorted((r.record_id, r.offset, r.length) for r in again.collect()) == sorted(
        (r.record_id, r.offset, r.length) for r in index.collect())


def test_damaged_archives_fail(spark, pages):
    row = write_archives(pages.coalesce(1)).first()
    files, path = filesystem(row.archive)
    with files.open_input_file(path) as f:
        data = f.read()
    broken = f"{staging_path(spark, 'broken')}.warc.gz"
    with filesystem(broken)[0].open_output_stream(filesystem(broken)[1], compression=None) as f:
        f.write(data[:len(data) // 2])
    with pytest.raises(Exception, match="breaks off|ends inside"):
        normalise_archives(spark.createDataFrame([(broken,)], "archive string")).count()


def test_no_pages(pages):
    archives = write_archives(pages.limit(0))
    assert read_records(normalise_archives(archives)).count() == 0


def test_escaping_is_reversible_and_hides_controls():
    draw = random.Random(1)
    parts = [*chat.CONTROLS, "<", ">", "\\", "[", "s>", "INST]", "/", "<\\s>", "[\\\\INST]", "a"]
    for _ in range(4_000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 9)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROLS)


CHATS = [(1, t, ("user", "assistant")[t % 2], f"turn {t} [INST] </s>", "z") for t in range(200)]
CHATS += [(2, 0, "system", "be <<SYS>>", "z"), (2, 1, "user", None, "z"), (2, 2, "assistant", "", "z"),
          (2, 2, "assistant", "", "z"), (3, None, None, "role?", "z"), (3, 1, "to[/ROLE]ol", "x\ny", "z"),
          (None, 0, "assistant", "nobody", "z"), (4, 0, "assistant", "long " * 50_000, "z")]


@pytest.fixture
def chats(spark):
    return spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string, start string")


def test_spans_equal_rendering_the_whole(chats):
    rows = chat.format_chats(chats.repartition(4)).collect()
    assert {r.status for r in rows} == {"appended"}
    for conv in (1, 2, 3, None, 4):
        turns = [(c[2] or "", c[3] or "") for c in sorted(
            (c for c in CHATS if c[0] == conv),
            key=lambda c: (c[1] is not None, c[1], c[2] or "", c[3] or ""))]
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)
        whole = "".join(r.rendered for r in own)
        assert whole == chat.instruct(turns)
        for r, (role, text) in zip(own, turns):
            assert chat.unescape(whole[r.text_start:r.text_end]) == text
            assert r.loss == (role == "assistant")
            assert chat.parse_turn(r.rendered) == (role, text)
    digests = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(chats)).collect()}
    trained = "".join(c[3] for c in CHATS if c[0] == 1 and c[2] == "assistant")
    assert digests[1].loss_chars == len(trained)
    assert digests[1].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
    assert len(digests) == 5 and chat.chat_digests(chat.format_chats(chats.limit(0))).count() == 0


def test_templates_that_rewrite_history_are_found(chats):
    def last_only(turns):  # drops earlier assistant texts, as some reasoning templates do
        return "".join(f"<{r}>{t if r != 'assistant' or i == len(turns) - 1 else ''}|"
                       for i, (r, t) in enumerate(turns))

    def counting(turns):  # depends on the whole conversation
        return "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns))

    rows = chat.format_chats(chats.where("conv_id = 1"), last_only).orderBy("position").collect()
    assert [r.status for r in rows[:4]] == ["appended", "appended", "rewritten", "appended"]
    rows = chat.format_chats(chats.where("conv_id = 1"), counting, chat.BLOCK).orderBy("position").collect()
    assert {r.status for r in rows[:chat.BLOCK]} == {"appended"}
    assert rows[chat.BLOCK].status == "far"


def last_forty(turns):
    return "".join(f"<{r}>{t}|" for r, t in turns[-40:])


def late_rewrite(turns):
    return "".join(f"<{'first' if i == 0 and len(turns) >= 50 else r}>{t}|"
                   for i, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns))


@pytest.mark.parametrize("template,first,status", [
    (last_forty, 40, "rewritten"), (late_rewrite, 49, "rewritten"), (numbered, chat.BLOCK, "far")])
@pytest.mark.parametrize("n", [50, 64, 200])
def test_long_conversations_equal_full_prefixes(chats, template, first, status, n):
    some = chats.where(f"conv_id = 1 AND turn < {n} OR conv_id = 2")
    rows = chat.format_chats(some, template, chat.BLOCK).orderBy("position").collect()
    own = [r for r in rows if r.conv_id == 1]
    turns = [(c[2], c[3]) for c in CHATS if c[0] == 1][:n]
    out = ""
    for i, r in enumerate(own, 1):
        out = out[:r.start] + r.rendered
        assert out == template(turns[:i]) and out[r.text_start:r.text_end] == turns[i - 1][1]
    assert {r.status for r in own[:first]} == {"appended"} and own[first].status == status
    if template is not late_rewrite:
        assert {r.status for r in own[first:]} == {status}
    assert len(own) == n and len(rows) == n + 4


def blinking(turns):  # says something of turn 1 at a few lengths only, between any comparisons
    return "".join(f"<{'odd' if i == 0 and len(turns) in (70, 71) else r}>{t}|"
                   for i, (r, t) in enumerate(turns))


@pytest.mark.parametrize("template", [last_forty, late_rewrite, numbered, blinking])
def test_whole_prefixes_are_the_default(chats, template):
    rows = chat.format_chats(chats.where("conv_id = 1 AND turn < 90"), template).orderBy("position").collect()
    turns = [(c[2], c[3]) for c in CHATS if c[0] == 1][:90]
    out, before = "", ""
    for i, r in enumerate(rows, 1):
        now = template(turns[:i])
        out = out[:r.start] + r.rendered
        assert out == now and r.status == ("appended" if now.startswith(before) else "rewritten")
        before = now


def test_a_template_that_is_not_local_is_refused(chats):
    def late(turns):
        return "".join(f"{'' if len(turns) > 40 and i == 0 else r}:{t}\n" for i, (r, t) in enumerate(turns))

    late.local = True
    with pytest.raises(Exception, match="declared local"):
        chat.format_chats(chats.where("conv_id = 1"), late).count()


def vectors(n, hot=0, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, 16))
    x = (centres[draw.integers(0, 12, n)] + draw.standard_normal((n, 16)) * .5).astype(np.float32)
    x[:hot] = x[0]
    return x


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)


def brute_force(x, q, k):
    scores = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
    keys = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:k]
    return [(i, scores[i]) for i in keys]


def test_few_vectors_are_searched_whole(spark):
    x = vectors(300, hot=120)
    odd = [(1_000, None, "e"), (1_001, [0.0] * 16, "e"), (1_002, [1.0, float("nan")] + [0.0] * 14, "e"),
           (1_003, [float("inf")] * 16, "e"), (1_004, [1.0] * 3, "e"), (None, x[3].tolist(), "e"),
           (1_005, [None] + [1.0] * 15, "e"), (1_006, [], "e")]
    df = frame(spark, x, odd)
    rows = nearest(df, df.where("vec_id % 20 = 0 OR vec_id > 999"), least_parts=1).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        assert found == brute_force(x, q, 20)


def test_fewer_candidates_than_asked_for(spark):
    df = frame(spark, vectors(5))
    rows = nearest(df, df.where("vec_id = 2")).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4]
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_given_vectors_go_through_learned_partitions(spark, monkeypatch):
    cut, plain = [], neighbours.balanced_parts
    monkeypatch.setattr(neighbours, "balanced_parts", lambda x, graph, parts: (
        cut.append(parts), plain(x, graph, parts))[1])
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = {}
    for r in nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    x, hits = np.array([v for _, v in rows], float), 0
    assert cut == [4] and [i for i, _ in rows] == list(range(len(x)))
    for q, got in found.items():
        hits += len(got & {i for i, _ in brute_force(x, q, 20)})
    assert len(found) == len(x) // 20 and hits >= 0.9 * 20 * len(found)


def test_recall_of_learned_partitions(spark):
    x = vectors(12_000, hot=4_500)
    df = frame(spark, x)
    rows = nearest(df, df.where("vec_id % 100 = 0"), sample=3_000).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(range(0, 12_000, 100))
    hits = 0
    for q, got in found.items():
        assert sorted(got) == list(range(1, 21))
        hits += len({i for i, _ in got.values()} & {i for i, _ in brute_force(x, q, 20)})
    assert hits >= 0.9 * 20 * len(found)


def test_the_default_template_is_rendered_with_whole_prefixes(chats, monkeypatch):
    assert not getattr(chat.instruct, "local", False)
    turns = [("user", "a"), ("assistant", "b")] * (2 * chat.BLOCK)
    seen = []

    def watched(prefix):
        seen.append(len(prefix))
        return chat.instruct(prefix)

    list(chat.rendered_turns(watched, turns))
    assert max(seen) == len(turns) and seen == [n for n in range(1, len(turns) + 1) for _ in "ab"]
