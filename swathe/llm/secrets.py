"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class.

Text is cut into tokens at everything no class has, and at '=' except at a token's end. In a token
every class takes its own maximal stretches; over each stretch a window of fixed width slides, its
entropy kept by adding and removing one character's count at a time. A span covers the windows that
reach the class's threshold; a stretch needs a digit and a letter. A match of the allow list takes
out the windows that touch it; it takes out its whole token if that is no longer than ``BOUNDED`` and
the match is no plain word between '/', '_' and '-'. The fixed patterns are not subject to it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from swathe.llm.tasks import slices, texts_of

# Fixed patterns; letters of the first one's keyword in either case (ASCII only).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    run: str        # a stretch of a token
    width: int      # characters of the window
    bits: float     # entropy per character that a window must reach


CLASSES = (EntropyClass("entropy_hex", r"[0-9A-Fa-f]+", 20, 3.0),
           EntropyClass("entropy_base64", r"[A-Za-z0-9+/_-]+={0,2}", 20, 3.9))

# Candidates that are no secrets: placeholders, alphabets, keys from manuals, identifiers.
ALLOW = (r"(?i)example|sample|placeholder|changeme|dummy|lorem",
         r"(?i)abcdefgh|01234567|12345678|qwerty", r"(.)\1{7}",
         r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
_WORD = re.compile(r"([a-z]+|[A-Z]+|[A-Z][a-z]+)[0-9]{0,3}")
BOUNDED = 64
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def entropy_spans(text: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of all windows of ``width`` characters with at least ``bits`` of entropy.

    With counts c the entropy is log2(width) - sum(c log2 c) / width; the sum changes by two terms
    when the window moves on.
    """
    if len(text) < width:
        return []
    term = [0.0] + [c * log2(c) for c in range(1, width + 1)]
    most = (log2(width) - bits) * width + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, letter in enumerate(text):
        c = counts.get(letter, 0)
        counts[letter] = c + 1
        total += term[c + 1] - term[c]
        if i >= width:
            old = text[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        begin = i - width + 1
        if begin >= 0 and total <= most:
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((begin, i + 1))
    return spans


class Scanner:
    def __init__(self, classes: Sequence[EntropyClass], allow: Sequence[str]):
        self.classes = [(c, re.compile(c.run)) for c in classes]
        self.allow = [re.compile(a) for a in allow]
        self.shortest = min((c.width for c in classes), default=0)
        self.order = {k: i for i, k in enumerate([*BASE, *(c.kind for c in classes)])}

    def allowed(self, token: str) -> list[tuple[int, int]]:
        """The parts of a token that are left alone, apart from each other, by start."""
        parts = []
        for a in self.allow:
            for m in a.finditer(token):
                if len(token) <= BOUNDED:
                    begin = max(token.rfind(c, 0, m.start()) for c in "/_-") + 1
                    end = min((e for c in "/_-" if (e := token.find(c, m.end())) >= 0),
                              default=len(token))
                    if not _WORD.fullmatch(token, begin, end):
                        return [(0, len(token))]
                parts.append(m.span())
        merged: list[tuple[int, int]] = []
        for begin, end in sorted(parts):
            if merged and begin <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(end, merged[-1][1])
            else:
                merged.append((begin, end))
        return merged

    def token(self, token: str) -> list[tuple[str, int, int]]:
        """Entropy spans of a token; one inside a span of an earlier class is left out."""
        added: list[tuple[str, int, int]] = []
        if not (_DIGIT.search(token) and _LETTER.search(token)):
            return added
        parts, earlier = self.allowed(token), Covers()
        for c, stretch in self.classes:
            own, next_part = [], 0
            for m in stretch.finditer(token):
                at, last = m.span()
                while at < last:
                    while next_part < len(parts) and parts[next_part][1] <= at:
                        next_part += 1
                    begin, end = parts[next_part] if next_part < len(parts) else (last, last)
                    piece = token[at:min(begin, last)]
                    if len(piece) >= c.width and _DIGIT.search(piece) and _LETTER.search(piece):
                        own += [(at + b, at + e) for b, e in entropy_spans(piece, c.width, c.bits)]
                    at = max(at + len(piece), min(end, last))
            added += [(c.kind, b, e) for b, e in own if not earlier.holds(b, e)]
            earlier.add(own)
            if stretch.fullmatch(token):
                break
        return added

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then by kind."""
        found = []
        lower = text.lower()
        if any(k in lower for k in KEYWORDS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            found += [("access", *m.span()) for m in ACCESS.finditer(text)
                      if len(m[0]) >= 16]
        added: list[tuple[str, int, int]] = []
        for m in _CANDIDATE.finditer(text):
            run, at = m[0], m.start()
            found += [("hex", at + h.start(), at + h.end()) for h in HEX.finditer(run)]
            if not (_DIGIT.search(run) and _LETTER.search(run)):
                continue
            for t in _TOKEN.finditer(run):
                if self.shortest <= len(t[0]):
                    added += [(k, at + t.start() + b, at + t.start() + e)
                              for k, b, e in self.token(t[0])]
        if added:
            base = Covers()
            for kind in BASE:
                base.add([(b, e) for k, b, e in found if k == kind])
            found += [s for s in added if not base.holds(s[1], s[2])]
        return sorted(found, key=lambda s: (s[1], self.order[s[0]], s[2]))


class Covers:
    """Lists of spans; those of one list are in order and do not overlap, so that only one of each
    can hold a given span."""

    def __init__(self):
        self.lists: list[tuple[list[int], list[int]]] = []

    def add(self, spans: list[tuple[int, int]]) -> None:
        if spans:
            self.lists.append(([b for b, _ in spans], [e for _, e in spans]))

    def holds(self, begin: int, end: int) -> bool:
        return any((i := bisect_right(begins, begin)) and ends[i - 1] >= end
                   for begins, ends in self.lists)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 classes: Sequence[EntropyClass] = CLASSES, allow: Sequence[str] = ALLOW
                 ) -> DataFrame:
    """``key`` and spans, an array of (kind, start, end) in code points, end exclusive.

    One row per row of ``docs``, in one pass without a shuffle; null and empty texts have no
    spans, null and repeated keys stay as they are, other columns are not read. Spans of the fixed
    patterns (assign, access, hex) are all there; an entropy span inside one of them is left out.
    A text of n characters takes time in proportion to n.
    """
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in slices(batches, "text"):
            spans = [[{"kind": k, "start": b, "end": e} for k, b, e in scanner.scan(t)]
                     for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(spans, pa.list_(span))], ["key", "spans"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        find, f"key {kind}, spans array<struct<kind:string,start:long,end:long>>"
    ).withColumnRenamed("key", key)


def redact(text: str, spans: Sequence[tuple[str, int, int]], mark: str) -> str:
    """Every stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for _, begin, end in spans:
        if begin >= at:
            out += [text[at:begin], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", size: str = "n_chars",
                   mark: str = "[SECRET]", classes: Sequence[EntropyClass] = CLASSES,
                   allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with the found spans of ``text`` replaced by ``mark``, all columns and rows kept.

    Where a text changed, the column ``size`` (if there is one) gets its new length in code
    points. Null texts stay null. No shuffle.
    """
    names = docs.columns
    at, sized = names.index(text), names.index(size) if size in names else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in slices(batches, text):
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            sizes = columns[sized].to_pylist() if sized is not None else None
            changed = False
            for i, value in enumerate(texts):
                if value and (spans := scanner.scan(value)):
                    texts[i], changed = redact(value, spans, mark), True
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            if changed:
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[sized] = pa.array(sizes, columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)
