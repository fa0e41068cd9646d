"""Personal data in texts, also in disguise: offset-preserving deobfuscation.

Small transducers (regular rewrite rules) rewrite a text step by step and keep, for every character they put out, the span of
source characters it stands for: invisible characters vanish, look-alikes become ASCII, spelled digits become digits, and written-out or
bracketed "at" and "dot" become @ and a dot. Detectors run on the source and on the rewritten text; what only the second
run finds is mapped back to source offsets and added, beside the plain match of a part of it.
"""

from __future__ import annotations

import bisect
import collections
import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import map_batches, unwrapped, wrapped

KINDS = ["email", "ip", "card", "phone"]
OWN = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
Span = tuple[str, int, int]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Look-alike letters and signs, and the ASCII characters they stand for.
_LOOK = "аеорсухіјѕԁһкмтАВЕКМНОРСТУХІЈЅαορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ﹫․·∙。｡‐‑‒–—−﹢"
_LIKE = "aeopcyxijsdhkmtABEKMHOPCTYXIJSaopviABEZHIKMNOPTYX@.....------+"
# Characters that show nothing.
_HIDDEN = "­​‌‍⁠﻿"
# Spelled digits.
_SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "|".join(_SPELLED)
_RUN = re.compile(rf"(?i)(?<![A-Za-z])(?:{_WORD})(?:(?:[ \t]*-[ \t]*|[ \t]+|[ \t]*,[ \t]*)?(?:{_WORD})(?![A-Za-z])|(?:[ \t]*\.[ \t]*|[ \t]+(?:dot|point)[ \t]+)(?:{_WORD})(?![A-Za-z])){{2,}}")
_ONE = re.compile(rf"(?i){_WORD}|[ \t]*(?:\.|\b(?:dot|point)\b)[ \t]*|[^A-Za-z]+")
_PLUS = re.compile(r"(?i)(?<![A-Za-z])plus[ \t]+(?=[0-9])")
_BRACKET_AT = re.compile(r"(?i)[ \t]*[\(\[\{<][ \t]*(?:at|@)[ \t]*[\)\]\}>][ \t]*")
_BRACKET_DOT = re.compile(r"(?i)[ \t]*[\(\[\{<][ \t]*(?:dot|point|\.)[ \t]*[\)\]\}>][ \t]*")
_WORDED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:@|[ \t]+(?:at|@)[ \t]+)[A-Za-z0-9-]+(?:(?:[ \t]+(?:dot|\.)[ \t]+|\.)[A-Za-z0-9-]+)+")
_SPACED_OUT = re.compile(r"(?i)[ \t](?:at|dot|@|\.)[ \t]")
_SPACED = re.compile(r"(?i)[ \t]+(at|dot|@|\.)[ \t]+")
_BRACKETED = re.compile(r"(?i)[\(\[\{<][ \t]*(?:at|dot|point|@|\.)[ \t]*[\)\]\}>]")
_FOREIGN = re.compile(r"[^\x00-\x7f]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each kind, without those that fail its test; in time linear in the text."""
    found: list[Span] = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                free = m.end()
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Tape:
    """A rewritten text and where its characters come from: ``edits`` lists (a, b, start, end) in order, for characters [a, b)
    that each stand for the source's [start, end); all others are copies. So memory grows with the edits, not with the text."""

    def __init__(self, text: str):
        self.text = text
        self.edits: list[tuple[int, int, int, int]] = []

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The source span of the characters [a, b), one at least."""
        first, last = (self.edits[i - 1] if (i := bisect.bisect_right(self.edits, at, key=lambda e: e[0])) else (0, 0, 0, 0) for at in (a, b - 1))
        start = first[2] if a < first[1] else first[3] + a - first[1]
        return start, last[3] if b - 1 < last[1] else last[3] + b - last[1]

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replaces [a, b) by a string, for changes in order; each new character stands for the whole piece replaced."""
        if not changes:
            return
        pieces, edits, at, shift = [], [], 0, 0
        old = collections.deque(self.edits)
        for a, b, new in changes:
            while old and (old[0][1] <= a if old[0][0] < old[0][1] else old[0][0] <= a):
                x, y, s, e = old.popleft()
                edits.append((x + shift, y + shift, s, e))
            if old and old[0][0] < a:  # an edit that the change cuts: its head stays
                edits.append((old[0][0] + shift, a + shift, *old[0][2:]))
            edits.append((a + shift, a + shift + len(new), *self.span(a, b)))
            while old and old[0][1] <= b and old[0][0] < b:
                old.popleft()
            if old and old[0][0] < b:  # its tail stays
                old.appendleft((b, *old.popleft()[1:]))
            pieces += [self.text[at:a], new]
            at, shift = b, shift + len(new) - (b - a)
        edits += [(x + shift, y + shift, s, e) for x, y, s, e in old]
        self.text, self.edits = "".join(pieces) + self.text[at:], edits


@functools.cache
def _ascii(c: str) -> str | None:
    """What a character reads as, if that isn't itself."""
    if c in _HIDDEN:
        return ""
    if (at := _LOOK.find(c)) >= 0:
        return _LIKE[at]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    return None if digit is None else str(digit)


def _digits(run: str) -> str:
    """A run of spelled digits as digits; dots stay, what else separates goes."""
    out = []
    for m in _ONE.finditer(run):
        piece = m[0].strip(" \t").lower()
        out.append(_SPELLED.get(piece, "." if piece in (".", "dot", "point") else ""))
    return "".join(out)


def _worded(m: re.Match, tape: Tape, source: str) -> bool:
    """An address with a worded " at " counts only beside another disguise in it: "a.b at c.d" alone is prose."""
    return " dot " in re.sub(r"[ \t]+", " ", m[0].lower()) or "@" in m[0] or source[slice(*tape.span(*m.span()))] != m[0]


def deobfuscate(text: str) -> Tape:
    """The rewritten text; its ``text`` is the source itself where no transducer changes anything."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(*m.span(), new) for m in _FOREIGN.finditer(text) if (new := _ascii(m[0])) is not None])
    for pattern, new in ((_RUN, lambda m: _digits(m[0])), (_PLUS, lambda m: "+")):
        tape.rewrite([(*m.span(), new(m)) for m in pattern.finditer(tape.text)])
    if _BRACKETED.search(tape.text):
        for pattern, new in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
            tape.rewrite([(*m.span(), new) for m in pattern.finditer(tape.text)])
    if _SPACED_OUT.search(tape.text):
        spaced = [(m.start() + x.start(), m.start() + x.end(), "@" if x[1].lower() in ("at", "@") else ".") for m in _WORDED.finditer(tape.text) if _worded(m, tape, text) for x in _SPACED.finditer(m[0])]
        tape.rewrite(spaced)
    return tape


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those of the rewritten text, also where these hold a part that is a base span."""
    base = detect(text)
    tape = deobfuscate(text)
    if tape.text == text:
        return base, base
    new = [(k, *tape.span(a, b)) for k, a, b in detect(tape.text)]
    return base, sorted(set(base + new), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per input row: its columns, then n_email, n_ip, n_card, n_phone (base spans), base, spans.

    Spans are kind:start:end, in code points, end exclusive, by start and then kind, joined by commas. ``base`` holds the
    plain matches, ``spans`` those and the disguised ones. A null text is empty and has none. Repeated rows come out each;
    an empty table gives an empty one; input columns with the names of these are replaced.
    """
    rows = wrapped(docs, "text", OWN)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t or "") for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(k == s[0] for s in base) for base, _ in found], pa.int64()) for k in KINDS]
        return pa.record_batch([batch.column(0), batch.column(1), *counts, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())], ["__row", "text", *OWN])

    kind = rows.schema["__row"].dataType.simpleString()
    done = map_batches(rows, make, f"__row {kind}, text string, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    return unwrapped(done, docs, "text", OWN)
