"""RDF files as tables of triples. N-Triples and N-Quads are read line by line by Spark; RDF/XML, Turtle and TriG file by
file, in tasks. Every reader gives (s, p, o_kind, o, o_num, xsd, graph)."""

from __future__ import annotations

import datetime
import itertools
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "s string, p string, o_kind string, o string, xsd string, graph string"
# The W3C's namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
# XSD types and the Spark types they are read as; others are text.
XSD_TYPES = {"string": "string", "boolean": "boolean", "double": "double", "float": "float", "integer": "int", "int": "int", "long": "bigint", "short": "smallint", "unsignedLong": "decimal(20,0)", "unsignedInt": "bigint", "unsignedShort": "int", "nonNegativeInteger": "int", "anyURI": "string"}
# possessive, so that a long literal needs no stack
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_LINE = rf'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|{_QUOTED}(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'


def _numbers(df: DataFrame) -> DataFrame:
    return df.withColumn("o_num", F.when(F.col("o_kind") == "lit", F.col("o").try_cast("double")))


def _unescape(text: Column) -> Column:
    """Escapes of a literal, in one pass from left to right."""
    def char(piece: Column) -> Column:
        code = F.unhex(F.substr(piece, F.lit(3)))
        named = F.create_map(*[F.lit(x) for pair in (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f")) for x in pair])
        second = F.substring(piece, 2, 1)
        return (
            F.when(~piece.startswith("\\"), piece).when(second == "u", F.decode(code, "UTF-16BE")).when(second == "U", F.decode(code, "UTF-32"))
            .otherwise(F.coalesce(F.try_element_at(named, second), second))
        )

    pieces = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]++"), F.lit(0))
    return F.when(text.contains("\\"), F.concat_ws("", F.transform(pieces, char))).otherwise(text)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of N-Triples or N-Quads files that are neither statements nor blank nor comments."""
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(?:#.*)?$"))


def ntriples(spark: SparkSession, path: str, graph: str = "default") -> DataFrame:
    """One statement a line; other lines are left out here and listed by ``malformed``."""
    lines = spark.read.text(path).where(F.col("value").rlike(_LINE))
    s, p, o, quoted, g = (F.regexp_extract("value", _LINE, i) for i in (1, 2, 3, 4, 5))
    literal = o.startswith('"')
    bare = F.regexp_replace(s, "^<|>$", "")
    value = F.when(literal, _unescape(quoted)).otherwise(F.regexp_replace(o, "^<|>$", ""))
    kind = F.when(literal, "lit").when(o.startswith("_:"), "blank").otherwise("iri")
    xsd = F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    named = F.coalesce(F.nullif(F.regexp_replace(g, "^<|>$", ""), F.lit("")), F.lit(graph))
    return _numbers(lines.select(bare.alias("s"), p.alias("p"), kind.alias("o_kind"), value.alias("o"), xsd.alias("xsd"), named.alias("graph")))


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def _xml_facts(content: bytes, origin: str) -> Iterator[tuple]:
    root = ET.fromstring(content)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")
    count = iter(range(1 << 30))

    def full(ref: str) -> str:
        return base + ref if ref.startswith("#") else ref

    def node(e: ET.Element) -> Iterator[tuple]:
        about, ident, blank = e.get(f"{{{RDF}}}about"), e.get(f"{{{RDF}}}ID"), e.get(f"{{{RDF}}}nodeID")
        s = full(about) if about is not None else f"{base}#{ident}" if ident else f"_:{origin}_{blank or f'b{next(count)}'}"
        if _iri(e.tag) != f"{RDF}Description":
            yield s, f"{RDF}type", "iri", _iri(e.tag), None
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/")):
                yield s, _iri(k), "lit", v, None
        for c in e:
            p, ref, blank = _iri(c.tag), c.get(f"{{{RDF}}}resource"), c.get(f"{{{RDF}}}nodeID")
            if ref is not None:
                yield s, p, "iri", full(ref), None
            elif blank is not None:
                yield s, p, "blank", f"_:{origin}_{blank}", None
            elif c.get(f"{{{RDF}}}parseType") == "Collection":
                at, last = (s, p), len(c) - 1
                for i, x in enumerate(c):
                    cell = f"_:{origin}_b{next(count)}"
                    yield *at, "blank", cell, None
                    inner = list(node(x))
                    yield cell, f"{RDF}first", "iri", x.get(f"{{{RDF}}}about") and full(x.get(f"{{{RDF}}}about")) or (inner[0][0] if inner else ""), None
                    yield from (f for f in inner if f[2:4] != ("iri", f"{RDF}Description"))
                    at = (cell, f"{RDF}rest")
                    if i == last:
                        yield *at, "iri", f"{RDF}nil", None
            elif len(c):
                for x in c:
                    inner = list(node(x))
                    if inner:
                        yield s, p, "blank" if inner[0][0].startswith("_:") else "iri", inner[0][0], None
                        yield from inner
            else:
                yield s, p, "lit", c.text or "", c.get(f"{{{RDF}}}datatype")

    for e in root:
        yield from node(e)


def rdf_xml(spark: SparkSession, path: str, graph: str = "default") -> DataFrame:
    """RDF/XML files; each file is parsed in one task, whose memory holds the file's tree. N-Triples is the way in for more."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                stem = re.sub(r"\W", "_", name.rsplit("/", 1)[-1])
                facts = ((*f, graph) for f in _xml_facts(content, stem))
                while rows := list(itertools.islice(facts, 10_000)):
                    yield pd.DataFrame(rows, columns=["s", "p", "o_kind", "o", "xsd", "graph"])

    return _numbers(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, COLUMNS))


_TOKEN = re.compile(
    r"""(?P<skip>(?:\s|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})|(?P<text>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
    r"""|(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<hat>\^\^)|(?P<blank>_:\w(?:[\w.-]*[\w-])?)|(?P<number>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"""
    r"""|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\](){}])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


class TurtleError(ValueError):
    """A file that isn't Turtle or TriG, with the place where that shows."""


class _Turtle:
    """Reads the statements of a Turtle or TriG text one by one: (s, p, kind, o, xsd, graph)."""

    def __init__(self, text: str, origin: str, graph: str):
        self.text, self.origin, self.graph, self.at = text, origin, graph, 0
        self.prefixes: dict[str, str] = {}
        self.base, self.blanks, self.found = "", 0, []
        self.kind, self.value = "", ""
        self.step()

    def step(self) -> None:
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise self.error("unknown character")
            self.begin, self.at = self.at, m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m[0]
                return
        self.begin, self.kind, self.value = self.at, "end", ""

    def error(self, what: str) -> TurtleError:
        return TurtleError(f"{self.origin}: {what} at line {self.text.count(chr(10), 0, self.at) + 1}: {self.text[self.at : self.at + 40]!r}")

    def take(self, *values: str) -> bool:
        if self.value in values and self.kind in ("mark", "word", "tag"):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.error(f"{value!r} expected before")

    def plain(self, text: str) -> str:
        named = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
        return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else named.get(m[3], m[3]), text)

    def iri(self) -> str:
        kind, value = self.kind, self.value
        self.step()
        if kind == "iri":
            return value[1:-1] if ":" in value else self.base + value[1:-1]
        if kind == "name":
            alias, _, rest = value.partition(":")
            return self.prefixes.get(alias, f"{alias}:") + re.sub(r"\\(.)", r"\1", rest)
        raise self.error("a name expected before")

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.origin}_b{self.blanks}"

    def say(self, s: str, p: str, o: tuple) -> None:
        self.found.append((s, p, *o, self.graph))

    def term(self) -> tuple[str, str, str | None]:
        kind, value = self.kind, self.value
        if kind in ("text", "long"):
            self.step()
            plain, xsd = self.plain(value[3:-3] if kind == "long" else value[1:-1]), None
            if self.kind == "hat":
                self.step()
                xsd = self.iri()
            elif self.kind == "tag":
                self.step()
            return "lit", plain, xsd
        if kind == "number":
            self.step()
            return "lit", value, XSD + ("integer" if re.fullmatch(r"[+-]?\d+", value) else "decimal" if "e" not in value.lower() else "double")
        if kind == "word" and value in ("true", "false"):
            self.step()
            return "lit", value, f"{XSD}boolean"
        if kind == "blank":
            self.step()
            return "blank", f"_:{self.origin}_{value[2:]}", None
        if self.take("["):
            node = self.fresh()
            if not self.take("]"):
                self.predicates(node)
                self.need("]")
            return "blank", node, None
        if self.take("("):
            cells = []
            while not self.take(")"):
                cells.append((self.fresh(), self.term()))
            for i, (cell, item) in enumerate(cells):
                self.say(cell, f"{RDF}first", item)
                self.say(cell, f"{RDF}rest", ("blank", cells[i + 1][0], None) if i + 1 < len(cells) else ("iri", f"{RDF}nil", None))
            return ("blank", cells[0][0], None) if cells else ("iri", f"{RDF}nil", None)
        return "iri", self.iri(), None

    def predicates(self, s: str) -> None:
        while True:
            p = f"{RDF}type" if self.take("a") else self.iri()
            self.say(s, p, self.term())
            while self.take(","):
                self.say(s, p, self.term())
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.value in (".", "]", "}"):
                return

    def triples(self) -> None:
        nested = self.value == "["
        kind, s, _ = self.term()
        if kind == "lit":
            raise self.error("a literal can't be a subject, before")
        if not (nested and self.value in (".", "}")):
            self.predicates(s)

    def statements(self) -> Iterator[tuple]:
        while self.kind != "end":
            if self.value.lower().lstrip("@") in ("prefix", "base"):
                sparql, what = self.kind == "word", self.value.lower().lstrip("@")
                self.step()
                if what == "base":
                    self.base = self.iri()
                else:
                    alias = self.value.partition(":")[0]
                    self.step()
                    self.prefixes[alias] = self.iri()
                if not sparql:
                    self.need(".")
            else:
                named = self.take("GRAPH")
                before = (self.at, self.begin, self.kind, self.value)
                name = self.iri() if self.kind in ("iri", "name") else None
                if self.value == "{" and self.kind == "mark":
                    self.need("{")
                    outer, self.graph = self.graph, name or self.graph
                    while not self.take("}"):
                        self.triples()
                        self.take(".")
                    self.graph = outer
                elif named:
                    raise self.error("'{' expected before")
                else:
                    self.at, self.begin, self.kind, self.value = before
                    self.triples()
                    self.need(".")
            yield from self.found
            self.found = []


def turtle(spark: SparkSession, path: str, graph: str = "default") -> DataFrame:
    """Turtle and TriG files; each is read in one task, files in parallel. A file that isn't in the language is an error."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                facts = _Turtle(content.decode(), re.sub(r"\W", "_", name.rsplit("/", 1)[-1]), graph).statements()
                while rows := list(itertools.islice(facts, 10_000)):
                    yield pd.DataFrame(rows, columns=["s", "p", "o_kind", "o", "xsd", "graph"])

    return _numbers(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, COLUMNS))


READERS = {"ntriples": ntriples, "nquads": ntriples, "rdfxml": rdf_xml, "turtle": turtle, "trig": turtle}


def load(spark: SparkSession, path: str, form: str | None = None, graph: str = "default") -> DataFrame:
    """By format, or by the path's ending."""
    endings = {"nt": "ntriples", "nq": "nquads", "owl": "rdfxml", "rdf": "rdfxml", "xml": "rdfxml", "ttl": "turtle", "trig": "trig"}
    return READERS[form or endings[path.rstrip("/").rsplit(".", 1)[-1]]](spark, path, graph)


def load_with_imports(spark: SparkSession, path: str, resolve) -> tuple[DataFrame, list[str]]:
    """A file and, breadth first, all that it imports (owl:imports); ``resolve`` maps an import's IRI to a path or None."""
    loaded, queue, out = [], [path], None
    while queue:
        nxt = queue.pop(0)
        if nxt in loaded:
            continue
        loaded.append(nxt)
        facts = load(spark, nxt, graph=origin(nxt))
        out = facts if out is None else out.unionByName(facts)
        imports = facts.where(F.col("p") == "http://www.w3.org/2002/07/owl#imports").select("o").distinct().collect()  # a file's header
        queue += [f for r in sorted(imports) if (f := resolve(r.o))]
    return out, loaded


def origin(path: str) -> str:
    """The name of the graph that a file's facts go to: its name without the ending."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def version(path: str) -> str:
    """vX.Y(.Z) in the path, or else today."""
    m = re.search(r"(?:^|/)v?([0-9]+(?:\.[0-9]+){1,2})(?=/|$)", path)
    return f"v{m[1]}" if m else datetime.date.today().isoformat()


def split_annotations(facts: DataFrame, properties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts without annotations, and the annotations."""
    note = F.col("p").isin(properties)
    return facts.where(~note), facts.where(note)


def typed(facts: DataFrame, xsd: str) -> DataFrame:
    """The literals of one XSD type with their value in the Spark type; what can't be read is null."""
    kind = XSD_TYPES.get(xsd.removeprefix(XSD), "string")
    return facts.where(F.col("xsd") == (xsd if xsd.startswith(XSD) else XSD + xsd)).withColumn("value", F.col("o").try_cast(kind))


def write(facts: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, a folder for each predicate, sorted by subject in files, so that patterns read little."""
    facts.repartition("p", F.pmod(F.xxhash64("s"), F.lit(64))).sortWithinPartitions("p", "s").write.mode(mode).partitionBy("p").parquet(path)
