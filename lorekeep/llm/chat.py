"""Chat formatting: a compiler for a small, sandboxed template language.

A template holds text, ``{{ expression }}`` and the statements ``for x in y``, ``if``/``elif``/``else`` and ``generation``,
each with its ``end...``. An expression is a quoted string, a name with ``.fields``, ``==``, ``!=``, ``not``, ``and``, ``or``,
``+`` and ``| filter``. Names reach only the given variables and mapping keys; there are no calls, attributes or imports. The
template is parsed into a tree, constant parts are folded, and the tree becomes nested Python closures. Rendering gives the
text and the spans that the model is to generate.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import slices

START, END = "<|im_start|>", "<|im_end|>"
CHATML = "{% for turn in turns %}" + START + "{{ turn.role | header }}\n{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}" + END + "\n{% endfor %}"


class TemplateError(ValueError):
    """A template that isn't in the language."""


def escape(text: str) -> str:
    """No control string is left: <| gets a backslash inside, and one more if it has some already."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def header(role: str) -> str:
    """A role on one line: backslashes and line feeds are written out, then control strings escaped."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unheader(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "header": header, "trim": str.strip, "upper": str.upper, "lower": str.lower}


@dataclass
class Node:
    """A part of the tree: a kind, its value and its children."""

    kind: str
    value: Any = None
    parts: list[Node] = field(default_factory=list)


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_LEXEME = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*)|(==|!=|[|+()]))")


def _lexemes(source: str) -> list[str]:
    found, at, source = [], 0, source.strip()
    while at < len(source):
        m = _LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"not an expression: {source!r}")
        found.append(m[0].strip())
        at = m.end()
    return found


def expression(source: str) -> Node:
    left = _lexemes(source)

    def take(*names: str) -> str | None:
        return left.pop(0) if left and left[0] in names else None

    def either() -> Node:
        node = both()
        while take("or"):
            node = Node("or", parts=[node, both()])
        return node

    def both() -> Node:
        node = negated()
        while take("and"):
            node = Node("and", parts=[node, negated()])
        return node

    def negated() -> Node:
        return Node("not", parts=[negated()]) if take("not") else compared()

    def compared() -> Node:
        node = joined()
        while op := take("==", "!="):
            node = Node(op, parts=[node, joined()])
        return node

    def joined() -> Node:
        node = filtered()
        while take("+"):
            node = Node("+", parts=[node, filtered()])
        return node

    def filtered() -> Node:
        node = atom()
        while take("|"):
            name = left.pop(0) if left else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", name, [node])
        return node

    def atom() -> Node:
        if not left:
            raise TemplateError(f"expression ends early: {source!r}")
        token = left.pop(0)
        if token == "(":
            node = either()
            if not take(")"):
                raise TemplateError(f"no closing bracket: {source!r}")
            return node
        if token[0] in "'\"":
            return Node("text", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1]))
        if not (token[0].isalpha() or token[0] == "_") or any(p.startswith("__") for p in token.split(".")):
            raise TemplateError(f"not allowed: {token!r}")
        return Node("name", token.split("."))

    node = either()
    if left:
        raise TemplateError(f"left over in {source!r}: {left}")
    return node


def parse(template: str) -> Node:
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _PIECE.finditer(template):
        pieces += [("text", template[at : m.start()])] * (m.start() > at)
        pieces.append(("print", m[1]) if m[1] is not None else ("do", m[2].strip()))
        at = m.end()
    pieces += [("text", template[at:])] * (at < len(template))

    def body(ends: tuple[str, ...]) -> tuple[Node, str]:
        node = Node("all")
        while pieces:
            kind, value = pieces.pop(0)
            if kind == "text":
                node.parts.append(Node("text", value))
            elif kind == "print":
                node.parts.append(expression(value))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return node, value
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip())
                    if not m:
                        raise TemplateError(f"not a loop: {value!r}")
                    node.parts.append(Node("for", m[1], [expression(m[2]), body(("endfor",))[0]]))
                elif word == "if":
                    node.parts.append(branch(rest))
                elif word == "generation":
                    node.parts.append(Node("generation", parts=[body(("endgeneration",))[0]]))
                else:
                    raise TemplateError(f"no statement {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return node, ""

    def branch(test: str) -> Node:
        then, end = body(("elif", "else", "endif"))
        word, _, rest = end.partition(" ")
        other = branch(rest) if word == "elif" else body(("endif",))[0] if word == "else" else Node("all")
        return Node("if", parts=[expression(test), then, other])

    return body(())[0]


def fold(node: Node) -> Node:
    """The same tree with constant parts worked out and neighbouring texts joined."""
    parts = [fold(p) for p in node.parts]
    values = [p.value for p in parts] if parts and all(p.kind == "text" for p in parts) else None
    if node.kind == "filter" and values:
        return Node("text", FILTERS[node.value](values[0]))
    if node.kind == "+" and values:
        return Node("text", values[0] + values[1])
    if node.kind in ("==", "!=") and values:
        return Node("truth", (values[0] == values[1]) == (node.kind == "=="))
    if node.kind == "not" and parts[0].kind == "truth":
        return Node("truth", not parts[0].value)
    if node.kind == "if" and parts[0].kind in ("truth", "text"):
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "all":
        flat: list[Node] = []
        for p in (q for part in parts for q in (part.parts if part.kind == "all" else [part])):
            if p.kind == "text" and flat and flat[-1].kind == "text":
                flat[-1] = Node("text", flat[-1].value + p.value)
            elif p.kind != "text" or p.value:
                flat.append(p)
        return flat[0] if len(flat) == 1 else Node("all", parts=flat)
    return Node(node.kind, node.value, parts)


Value = Callable[[dict], Any]
Step = Callable[[dict], Iterator[str | bool]]  # what is put out, True where a generation begins and False where it ends


def _value(node: Node) -> Value:
    if node.kind in ("text", "truth"):
        return lambda scope, v=node.value: v
    if node.kind == "name":

        def look(scope: dict, path: list[str] = node.value) -> Any:
            found: Any = scope
            for step in path:
                if not isinstance(found, dict) or step not in found:
                    raise TemplateError(f"no value {'.'.join(path)!r}")
                found = found[step]
            return found

        return look
    sub = [_value(p) for p in node.parts]
    if node.kind == "filter":
        return lambda scope, f=FILTERS[node.value], a=sub[0]: f(a(scope))
    if node.kind == "not":
        return lambda scope, a=sub[0]: not a(scope)
    a, b = sub
    return {
        "+": lambda scope: a(scope) + b(scope), "==": lambda scope: a(scope) == b(scope), "!=": lambda scope: a(scope) != b(scope),
        "and": lambda scope: a(scope) and b(scope), "or": lambda scope: a(scope) or b(scope),
    }[node.kind]


def _step(node: Node) -> Step:
    if node.kind == "text":
        return lambda scope, v=node.value: iter((v,))
    if node.kind == "all":
        steps = [_step(p) for p in node.parts]

        def run_all(scope: dict) -> Iterator[str | bool]:
            for s in steps:
                yield from s(scope)

        return run_all
    if node.kind == "for":
        items, inside, name = _value(node.parts[0]), _step(node.parts[1]), node.value

        def run_for(scope: dict) -> Iterator[str | bool]:
            for item in items(scope):
                yield from inside({**scope, name: item})

        return run_for
    if node.kind == "if":
        test, then, other = _value(node.parts[0]), _step(node.parts[1]), _step(node.parts[2])
        return lambda scope: then(scope) if test(scope) else other(scope)
    if node.kind == "generation":
        inside = _step(node.parts[0])

        def run_generation(scope: dict) -> Iterator[str | bool]:
            yield True
            yield from inside(scope)
            yield False

        return run_generation
    value = _value(node)

    def run_value(scope: dict) -> Iterator[str | bool]:
        found = value(scope)
        if not isinstance(found, str):
            raise TemplateError(f"only text can be put out, not {found!r}")
        yield found

    return run_value


def compile_steps(template: str) -> Step:
    """A function from variables to the stream of a template's outputs and generation marks."""
    return _step(fold(parse(template)))


def pieces(stream: Iterable[str | bool], size: float) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts of a stream, each with its generation spans that aren't empty, in its own code points.

    A piece ends behind the output that brings it to ``size`` code points, and a span that goes on is cut there, so that only
    one piece is in memory. There is always one piece.
    """
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    length = start = depth = given = 0
    for event in stream:
        if isinstance(event, str):
            parts.append(event)
            length += len(event)
            if length >= size:
                yield "".join(parts), [*spans, (start, length)] if depth and length > start else spans
                parts, spans, length, start, given = [], [], 0, 0, given + 1
        elif event:
            start, depth = start if depth else length, depth + 1
        else:
            depth -= 1
            if not depth and length > start:
                spans.append((start, length))
    if length or not given:
        yield "".join(parts), spans


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the text and its generation spans."""
    steps = compile_steps(template)
    return lambda scope: next(pieces(steps(scope), math.inf))


def read_back(text: str) -> Iterator[tuple[str, str, int]]:
    """Role, text and end of each whole turn at the start of a text in the default template."""
    at = 0
    while (line := text.find("\n", at)) >= 0 and (end := text.find(END + "\n", line + 1)) >= 0:
        role, said, at = unheader(text[at + len(START) : line]), unescape(text[line + 1 : end]), end + len(END) + 1
        yield role, said, at


class Turns:
    """A conversation's turns as they stream past, which a template can loop over once."""

    def __init__(self, rows: Iterator[tuple]) -> None:
        self.rows, self.begun, self.count = rows, False, 0

    def _pass(self) -> Iterator[dict]:
        for _, turn, role, text in self.rows:
            self.count += 1
            yield {"turn": turn, "role": role, "text": text}

    def __iter__(self) -> Iterator[dict]:
        if self.begun:
            raise TemplateError("a template can loop over the turns of a table only once")
        self.begun = True
        return self._pass()

    def rest(self) -> Iterator[str]:
        """Reads the turns that the template left, and puts out nothing."""
        for _ in self._pass():
            pass
        yield from ()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple[int, tuple]], schema: pa.Schema, many: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their sizes."""
    held, total = [], 0
    for weight, row in rows:
        held.append(row)
        total += weight
        if len(held) >= many or total >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_chats(conversations: DataFrame, template: str = CHATML, piece_chars: int = 1 << 20) -> DataFrame:
    """Conversations as text: conv_id, piece, n_turns (begun in it), formatted, loss_spans (start, end: its code points under the loss).

    Turns go by turn number, then role and text; null roles and texts are empty; rows without conv_id are one conversation;
    an empty table gives an empty one; other columns are ignored. Turns are sorted by Spark, which spills, and stream through
    the template, so that a conversation of any length needs the memory of one piece; most are one piece, numbered 0. A
    conversation's pieces follow one another in one partition. conv_id is a whole number.
    """
    said = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *said)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(span))])

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        steps = compile_steps(template)
        for conv_id, group in itertools.groupby(_rows(batches), key=lambda row: row[0]):
            told, seen = Turns(group), 0
            for number, (text, spans) in enumerate(pieces(itertools.chain(steps({"turns": told}), told.rest()), piece_chars)):
                yield len(text), (conv_id, number, told.count - seen, text, [{"start": a, "end": b} for a, b in spans])
                seen = told.count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rendered(batches), schema)

    return ordered.mapInArrow(run, "conv_id long, piece long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


class Reader:
    """Reads a conversation back piece by piece: hashes of its turns and of the text under the loss."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for s in spans:
            said = unescape(text[s["start"] : s["end"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.rest, at = self.rest + text, 0
        for role, said, at in read_back(self.rest):
            self.turns += 1
            self.whole.update(f"{role}\n{said}\n".encode())
        self.rest = self.rest[at:]

    def found(self, conv_id: int | None) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv_id} ends within a turn: {self.rest[:40]!r}")
        return conv_id, self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats in the default template: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, a row per conversation.

    A conversation's pieces must follow one another as format_chats gives them; behind a shuffle, or read from files, repartition
    by conv_id and sortWithinPartitions by conv_id and piece first. A piece out of order is an error. An empty table gives an
    empty one.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for conv_id, group in itertools.groupby(_rows(batches), key=lambda row: row[0]):
            reader = Reader()
            for number, (_, piece, text, spans) in enumerate(group):
                if piece != number:
                    raise ValueError(f"piece {piece} of conversation {conv_id} stands where piece {number} should")
                reader.add(text, spans)
            yield 0, reader.found(conv_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(read(batches), schema)

    slim = formatted.select("conv_id", "piece", "formatted", "loss_spans")
    return slim.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
