"""Chat formatting with black-box templates: turn spans by comparing renderings of prefixes.

A template is any function from a list of (role, text) turns to a string. Turn k's share of the
output is what the rendering of k turns adds to that of k - 1. If the longer rendering does not
begin with the shorter one, the template rewrites history. Where the text lies inside that share
is found by rendering once more with a one-character probe in its place.

Long conversations are rendered in blocks that restart from the last ``context`` turns. The first
turn of a block is rendered from both the old and the new start, and at doubling numbers of turns
and at the end the whole conversation is rendered and compared with the output so far. At the first
difference the conversation is done again with full prefixes, so its output is the template's own;
turns that a block would have rendered otherwise say so. Blocks are only used where they are asked
for: with ``block``, or by a template that declares itself ``local`` (each turn rendered by itself).
The default template makes no such claim; it is rendered with whole prefixes like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from io import StringIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.llm.tasks import slices

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_HIDDEN = re.compile("|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in CONTROLS))
PROBE = "\x1a"
BLOCK, CONTEXT = 32, 2
CHECKED = 8  # conversations per task on which a local template is checked


def escape(text: str) -> str:
    """Put a backslash behind the first character of control strings, one more where there are
    some; :func:`unescape` takes it away again."""
    return _HIDDEN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _HIDDEN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def instruct(turns: Turns) -> str:
    """Default template: marked turns, control strings inside texts and roles escaped."""
    marks = {"user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>"),
             "system": ("<<SYS>>", "<</SYS>>")}
    out = ["<s>"]
    for role, text in turns:
        before, after = marks.get(role, (f"[ROLE]{escape(role)}[/ROLE]", "</s>"))
        out += [before, escape(text), after]
    return "".join(out)


def parse_turn(share: str) -> tuple[str, str]:
    """Role and text back from a turn's share of :func:`instruct`'s output."""
    share = share.removeprefix("<s>")
    for role, before, after in (("user", "[INST] ", " [/INST]"),
                                ("system", "<<SYS>>", "<</SYS>>")):
        if share.startswith(before):
            return role, unescape(share[len(before):-len(after)])
    if share.startswith("[ROLE]"):
        role, _, share = share.removeprefix("[ROLE]").partition("[/ROLE]")
        return unescape(role), unescape(share.removesuffix("</s>"))
    return "assistant", unescape(share.removesuffix("</s>"))


class Renderer:
    """One conversation, turn by turn; in blocks of ``block`` turns (0: full prefixes)."""

    def __init__(self, template: Template, block: int = BLOCK):
        self.block = block
        self.template, self.turns, self.done, self.total, self.fresh = template, [], "", 0, 0

    def add(self, role: str, text: str) -> tuple[str, int, int, int, str]:
        """The turn's share, its offset, the text's offsets and the status."""
        if self.block and self.fresh >= self.block:
            after = self.template([*self.turns, (role, text)])
            start = self.turns[-CONTEXT:]
            done = self.template(start)
            far = self.template([*start, (role, text)]).removeprefix(done) != after.removeprefix(
                self.done)
            self.turns, self.done, self.fresh = start, done, 0
        else:
            far = False
        now, probed = (self.template([*self.turns, (role, t)]) for t in (text, PROBE))
        kept, status = self.done, "far" if far else "appended"
        if not now.startswith(kept):
            n = min(len(now), len(kept))
            kept = kept[:next((i for i in range(n) if now[i] != kept[i]), n)]
            status = "rewritten"
        share = now[len(kept):]
        at = probed.find(PROBE, len(kept))
        begin = at - len(kept) if at >= 0 else 0
        end = len(share) - (len(probed) - at - 1) if at >= 0 else 0
        offset = self.total - (len(self.done) - len(kept))
        self.total = offset + len(share)
        self.turns.append((role, text))
        self.done, self.fresh = now, self.fresh + 1
        return share, offset, offset + begin, offset + max(begin, end), status


def rendered_turns(template: Template, turns: Turns, block: int = 0
                   ) -> Iterator[tuple[str, int, int, int, str]]:
    """What :meth:`Renderer.add` gives for each turn of a whole conversation, from full prefixes.
    With ``block``, from blocks that are compared with full renderings now and then; all from full
    prefixes if they differ."""
    if not block:
        full = Renderer(template, 0)
        yield from (full.add(*turn) for turn in turns)
        return
    blocks, out, rows, check = Renderer(template, block), StringIO(newline=""), [], 2 * block
    for n, turn in enumerate(turns, 1):
        rows.append(blocks.add(*turn))
        share, offset, status = rows[-1][0], rows[-1][1], rows[-1][-1]
        out.seek(max(0, offset))
        out.truncate()
        out.write(share)
        whole = n == check or n == len(turns) > block
        check = 2 * check if n == check else check
        if offset < 0 or status == "far" or whole and out.getvalue() != template(turns[:n]):
            break
    else:
        yield from rows
        return
    blocks, full = Renderer(template, block), Renderer(template, 0)
    for turn in turns:
        other, own = blocks.add(*turn), full.add(*turn)
        yield (*own[:-1], "far") if own[-1] == "appended" and other[0] != own[0] else own


def format_chats(chats: DataFrame, template: Template = instruct, block: int = 0,
                 conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
                 ) -> DataFrame:
    """A row per turn: ``conv``, position, rendered, start, text_start, text_end, loss, status.

    A conversation's output is its ``rendered`` strings in order of position; offsets are code
    points in it. loss marks the turns (assistant) whose text is trained on. status is 'appended',
'rewritten' (the template changed what it had said of earlier turns) or, with ``block``, 'far'.

    Every turn is rendered with the whole prefix before it, in time with the square of a
    conversation's length. ``block`` trades that for blocks of so many turns that restart from
    ``CONTEXT`` turns: 'far' marks shares that depend on more, and differences that come and go
    between two comparisons (at 2, 4, 8, ... blocks and the end) are not seen. A template that
    declares itself ``local`` depends on no other turn: it is rendered in blocks, and that is
    checked against whole prefixes on the first turns of some conversations of every task.

    Turns are ordered by ``turn`` (null first), then role and text, so repeated rows are turns of
    their own. Null roles and texts are empty; rows with a null ``conv`` are one conversation;
    other columns are not read; no rows, no output. One shuffle. A conversation is read turn by
    turn in one task, which holds one block of it with a ``local`` template, else all of it.
    """
    kind = chats.schema[conv].dataType.simpleString()
    laid = chats.select(
        chats[conv].alias("conv"), chats[turn].alias("turn"),
        F.coalesce(chats[role], F.lit("")).alias("role"),
        F.coalesce(chats[text], F.lit("")).alias("text"))
    laid = laid.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    names = ["conv", "position", "rendered", "start", "text_start", "text_end", "loss", "status"]

    def render_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple = ()
        turns: Turns = []

        def close() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for i, ((r, _), (share, *at, status)) in enumerate(
                    zip(turns, rendered_turns(template, turns, block)), 1):
                rows.append((current[0], i - 1, share, *at, r == "assistant", status))
                size += len(share)
                if size > 4_000_000 or i == len(turns):
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], current[1]),
                         *(pa.array(list(x)) for x in columns[1:])], names)
                    rows, size = [], 0

        for batch in slices(batches, "text"):
            kind_of = batch.schema.field("conv").type
            for c, r, t in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
                if current != (c, kind_of):
                    yield from close()
                    current, turns = (c, kind_of), []
                turns.append((r, t))
        yield from close()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple = ()
        position = seen = 0
        for batch in slices(batches, "text"):
            rows = []
            for c, r, t in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text"))):
                if current != (c,):
                    current, position, chat = (c,), 0, Renderer(template)
                    seen += 1
                    whole = Renderer(template, 0)
                share, start, begin, end, status = chat.add(r, t)
                if seen <= CHECKED and position < 2 * BLOCK and whole.add(r, t) != (
                        share, start, begin, end, status):
                    raise ValueError("the template is declared local, but a turn's share depends "
                                     f"on other turns (turn {position} of a conversation)")
                rows.append((position, share, start, begin, end, r == "assistant", status))
                position += 1
            columns = [pa.array(list(x)) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *columns], names)

    return laid.select("conv", "role", "text").mapInArrow(
        render if getattr(template, "local", False) else render_whole, f"conv {kind}, position long, rendered string, start long, text_start long, "
                "text_end long, loss boolean, status string").withColumnRenamed("conv", conv)


def chat_digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read formatted conversations of :func:`instruct` back: ``conv``, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Roles and texts are parsed from the rendered strings, the trained text is cut out by its
    offsets; digests are updated turn by turn, so a conversation's length needs no memory.
    """
    kind = formatted.schema[conv].dataType.simpleString()
    laid = formatted.select(formatted[conv].alias("conv"), "position", "rendered", "start",
                            "text_start", "text_end", "loss")
    laid = laid.repartition("conv").sortWithinPartitions("conv", "position")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple = ()
        state: list = []
        conv_type = None

        def result(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], conv_type), *(pa.array(list(c)) for c in columns[1:])],
                names)

        def close() -> tuple:
            n, turns, chars, loss, total = state
            return (current[0], n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for batch in slices(batches, "rendered"):
            conv_type = batch.schema.field("conv").type
            rows = []
            for c, share, start, begin, end, loss in zip(*(batch.column(n).to_pylist() for n in (
                    "conv", "rendered", "start", "text_start", "text_end", "loss"))):
                if current != (c,):
                    if current:
                        rows.append(close())
                    current, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(share)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss:
                    trained = unescape(share[begin - start:end - start])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(share)
            if rows:
                yield result(rows)
        if current:
            yield result([close()])

    return laid.mapInArrow(
        read, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, "
              "loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)
