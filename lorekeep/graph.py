"""A knowledge graph over DataFrames: a table of framed triples, and columns of other tables that are read as predicates."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import bindings
from lorekeep.operators.intervals import merge_overlapping
from lorekeep.operators.taxonomy import reach
from lorekeep.terms import Frame, Op, Pattern, is_var

TRIPLES = "s string, p string, o_kind string, o string, o_num double, graph string, agent string, uncertain boolean, confidence double, occasional boolean, begin double, end double"
FIELDS = ["graph", "agent", "uncertain", "confidence", "occasional", "begin", "end"]
TAXONOMIC = {"subClassOf", "subPropertyOf"}


@dataclass
class Mapped:
    """A predicate that is a column of a table: facts (subject, object), and columns that say when and how sure."""

    table: DataFrame
    subject: str
    object: str
    frame: dict[str, Column] = field(default_factory=dict)


class UnknownPredicate(LookupError):
    """Nothing is known of a predicate, so that neither yes nor no is an answer."""


class Graph:
    """Predicates are looked up as mapped columns, then as reasoners, then in the triples; what several give is united."""

    def __init__(self, spark: SparkSession, triples: DataFrame | None = None):
        self.spark = spark
        self.triples = triples if triples is not None else spark.createDataFrame([], TRIPLES)
        self._stores = {} if triples is not None else None  # whether there are facts, by predicates; None: no facts at all
        self.mapped: dict[str, Mapped] = {}
        self.reasoners: dict[str, Callable[[Pattern], DataFrame]] = {}
        self.sub_properties: dict[str, set[str]] = {}
        self.imports: dict[str, set[str]] = {}
        self.inverses: dict[str, set[str]] = {}
        self.symmetric: set[str] = set()
        self.transitive: set[str] = set(TAXONOMIC)

    # vocabulary

    def map(self, predicate: str, table: DataFrame, subject: str, object: str, **frame: Column) -> Graph:
        self.mapped[predicate] = Mapped(table, subject, object, frame)
        return self

    def reasoner(self, predicate: str, answer: Callable[[Pattern], DataFrame]) -> Graph:
        """A predicate that a function answers with a DataFrame (s, o)."""
        self.reasoners[predicate] = answer
        return self

    def sub_property(self, sub: str, sup: str) -> Graph:
        self.sub_properties.setdefault(sup, set()).add(sub)
        return self

    def inverse(self, p: str, q: str) -> Graph:
        """Each of two predicates holds backwards where the other does."""
        for a, b in ((p, q), (q, p)):
            self.inverses.setdefault(a, set()).add(b)
        return self

    def flags(self, predicate: str, symmetric: bool = False, transitive: bool = False) -> Graph:
        """A predicate holds both ways, or over chains of itself; its patterns answer so. subClassOf and subPropertyOf are transitive."""
        self.symmetric |= {predicate} if symmetric else set()
        self.transitive |= {predicate} if transitive else set()
        return self

    def declare(self, facts: DataFrame) -> Graph:
        """Takes inverses, flags and super-properties from facts (s, p, o) of a vocabulary, which is small."""
        kinds = {"SymmetricProperty": "symmetric", "TransitiveProperty": "transitive"}
        told = facts.where(F.col("p").isin("inverseOf", "subPropertyOf") | (F.col("p") == "type") & F.col("o").isin(list(kinds))).select("s", "p", "o").distinct()
        for r in told.collect():
            if r.p == "inverseOf":
                self.inverse(r.s, r.o)
            elif r.p == "subPropertyOf":
                self.sub_property(r.s, r.o)
            else:
                self.flags(r.s, **{kinds[r.o]: True})
        return self

    def import_graph(self, graph: str, imported: str) -> Graph:
        self.imports.setdefault(graph, set()).add(imported)
        return self

    @staticmethod
    def _below(edges: dict[str, set[str]], start: tuple[str, ...]) -> tuple[str, ...]:
        """start and all it leads to; vocabularies are small."""
        found, open_ = dict.fromkeys(start), list(start)
        while open_:
            for n in sorted(edges.get(open_.pop(), ())):
                if n not in found:
                    found[n] = None
                    open_.append(n)
        return tuple(found)

    # reading

    def match(self, pattern: Pattern, with_frame: bool = False, numeric: bool = False, with_origin: bool = False) -> DataFrame:
        """The bindings of one pattern. A predicate also has the facts of its sub-properties; ``type`` those of subclasses;
        inverse, symmetric and transitive predicates those that follow from this (the latter without frames).

        Variables bind to native values of mapped columns and to text (with numeric, to numbers) of triples. Filters and
        the choice of columns reach the scan. ``with_origin`` adds _graph and _agent to the frame's columns.
        """
        if not is_var(pattern.p):
            if pattern.p in self.transitive:
                return self._closed(pattern, numeric)
            back = set(self.inverses.get(pattern.p, ())) | ({pattern.p} & self.symmetric)
            if back:
                ahead = self._direct(pattern, with_frame or with_origin, numeric, with_origin)
                turned = [self._direct(Pattern(pattern.o, q, pattern.s, pattern.frame), with_frame or with_origin, numeric, with_origin) for q in sorted(back)]
                return bindings.union(ahead, *turned).distinct()
        return self._direct(pattern, with_frame or with_origin, numeric, with_origin)

    def _closed(self, pattern: Pattern, numeric: bool) -> DataFrame:
        """A transitive predicate's pattern: only what a constant end reaches is closed."""
        back = set(self.inverses.get(pattern.p, ())) | ({pattern.p} & self.symmetric)
        edges = self._direct(Pattern("?src", pattern.p, "?dst", pattern.frame), False, False)
        for q in sorted(back):
            edges = edges.unionByName(self._direct(Pattern("?dst", q, "?src", pattern.frame), False, False))
        if not isinstance(pattern.s, Op) and not is_var(pattern.s):
            found = reach(edges, start=self.spark.createDataFrame([(pattern.s,)], "src string"))
        elif not isinstance(pattern.o, Op) and not is_var(pattern.o):
            found = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start=self.spark.createDataFrame([(pattern.o,)], "src string"))
            found = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        else:
            found = reach(edges)
        dst = F.col("dst").try_cast("double") if numeric else F.col("dst")
        return self._project(Pattern(pattern.s, pattern.p, pattern.o), found.select("src", "dst").distinct(), F.col("src"), dst, {}, False)

    def _direct(self, pattern: Pattern, with_frame: bool, numeric: bool, with_origin: bool = False) -> DataFrame:
        names = self._below(self.sub_properties, (pattern.p,))
        known = [self._mapped(pattern, self.mapped[n], with_frame, with_origin) for n in names if n in self.mapped]
        known += [self._project(pattern, self.reasoners[n](pattern), F.col("s"), F.col("o"), {}, with_frame, with_origin=with_origin) for n in names if n in self.reasoners]
        if not known or is_var(pattern.p) or self._has_triples(names):
            known.append(self._stored(pattern, names, with_frame, numeric, with_origin))
        return bindings.union(*known)

    def _has_triples(self, names: tuple[str, ...]) -> bool:
        """Looked up once for each predicate; a graph of mapped columns alone needs no job for it."""
        if self._stores is None:
            return False
        if names not in self._stores:
            self._stores[names] = bool(self.triples.where(F.col("p").isin(list(names))).limit(1).count())
        return self._stores[names]

    def _project(self, pattern: Pattern, facts: DataFrame, s: Column, o: Column, frame: dict[str, Column], with_frame: bool, p: Column | None = None, with_origin: bool = False) -> DataFrame:
        terms = [(pattern.s, s), (pattern.o, o)] + ([(pattern.p, p)] if p is not None else [])
        tests, out = [], {}
        for term, column in terms:
            var = term.var if isinstance(term, Op) else term if is_var(term) else None
            if isinstance(term, Op):
                tests.append(term.test(column))
            elif var is None:
                tests.append(column == F.lit(term))
            if var and var[1:] in out:
                tests.append(out[var[1:]] == column)
            elif var:
                out[var[1:]] = column
        tests.append(pattern.frame.condition(frame, self._below(self.imports, pattern.frame.graphs)))
        columns = [c.alias(v) for v, c in out.items()]
        if with_frame:
            unset = {"uncertain": F.lit(False), "occasional": F.lit(False), "confidence": F.lit(None).cast("double"), "begin": F.lit(None).cast("double"), "end": F.lit(None).cast("double")}
            if with_origin:
                unset |= {"graph": F.lit(None).cast("string"), "agent": F.lit(None).cast("string")}
            columns += [F.coalesce(frame.get(k, v), v).alias(f"_{k}") for k, v in unset.items()]
        return facts.where(reduce(Column.__and__, tests)).select(*columns)

    def _mapped(self, pattern: Pattern, m: Mapped, with_frame: bool, with_origin: bool) -> DataFrame:
        facts = m.table.where(F.col(m.subject).isNotNull() & F.col(m.object).isNotNull())
        return self._project(pattern, facts, F.col(m.subject), F.col(m.object), m.frame, with_frame, with_origin=with_origin)

    def _stored(self, pattern: Pattern, names: tuple[str, ...], with_frame: bool, numeric: bool, with_origin: bool) -> DataFrame:
        facts = self.triples if is_var(pattern.p) else self.triples.where(F.col("p").isin(list(names)))
        value = pattern.o.value if isinstance(pattern.o, Op) else pattern.o
        facts = facts.where("s IS NOT NULL").where("p IS NOT NULL").where("o IS NOT NULL")
        number = numeric or isinstance(value, int | float) or isinstance(value, tuple) and all(isinstance(v, int | float) for v in value)
        o = F.col("o_num") if number else F.col("o")
        if pattern.p == "type" and isinstance(pattern.o, str) and not is_var(pattern.o):  # a subclass's instances count
            classes = self.subclasses().where(F.col("sup") == pattern.o).select(F.col("sub").alias("o"))
            facts = facts.join(classes.unionByName(self.spark.createDataFrame([(pattern.o,)], "o string")).distinct(), "o", "left_semi")
            pattern = Pattern(pattern.s, pattern.p, "?__class", pattern.frame)
            found = self._project(pattern, facts, F.col("s"), F.col("o"), {k: F.col(k) for k in FIELDS}, with_frame, with_origin=with_origin)
            return found.drop("__class").distinct()
        p = F.col("p") if is_var(pattern.p) else None
        return self._project(pattern, facts, F.col("s"), o, {k: F.col(k) for k in FIELDS}, with_frame, p, with_origin)

    def ask(self, *patterns: Pattern, with_frame: bool = False, unique: bool = False, with_origin: bool = False) -> DataFrame:
        """The conjunction of patterns. They are joined so that each shares a variable with those before, if one does."""
        left, open_ = None, list(patterns)
        bound: set[str] = set()
        while open_:
            nxt = next((p for p in open_ if bound & set(p.variables())), open_[0])
            open_.remove(nxt)
            found = self.match(nxt, with_frame, with_origin=with_origin)
            left = found if left is None else bindings.join(left, found)
            bound |= set(nxt.variables())
        return left.distinct() if unique else left

    def ask_one(self, *patterns: Pattern) -> dict | None:
        rows = self.ask(*patterns).limit(1).collect()
        return rows[0].asDict() if rows else None

    def ask_iter(self, *patterns: Pattern):
        """Answers one by one, fetched partition by partition."""
        return (r.asDict() for r in self.ask(*patterns).toLocalIterator())

    def holds(self, pattern: Pattern) -> bool:
        """Whether there is an answer; UnknownPredicate if nothing at all is known of the predicate."""
        self.known(pattern.p)
        return bool(self.match(pattern).limit(1).count())

    def known(self, predicate: str) -> None:
        """UnknownPredicate if nothing at all is known of the predicate."""
        names = self._below(self.sub_properties, (predicate,))
        names += tuple(q for n in names for q in sorted(self.inverses.get(n, ())))
        if not is_var(predicate) and not any(n in self.mapped or n in self.reasoners for n in names) and not self._has_triples(names):
            raise UnknownPredicate(predicate)

    def subclasses(self) -> DataFrame:
        """(sub, sup, depth): the closure of subClassOf."""
        edges = self.triples.where("p = 'subClassOf'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
        return reach(edges).select(F.col("src").alias("sub"), F.col("dst").alias("sup"), "depth")

    def counters(self) -> DataFrame:
        """(p, n): facts of each stored predicate."""
        return self.triples.groupBy("p").agg(F.count("*").alias("n"))

    # writing: a new graph each time; what is written where is up to the caller

    def _with(self, triples: DataFrame) -> Graph:
        graph = Graph(self.spark, triples)
        for name in ("mapped", "reasoners", "sub_properties", "imports", "inverses", "symmetric", "transitive"):
            setattr(graph, name, getattr(self, name))
        return graph

    def tell(self, facts: DataFrame) -> Graph:
        """Adds facts; columns of the frame that they lack are unset."""
        return self._with(self.triples.unionByName(framed(facts)))

    def forget(self, facts: DataFrame) -> Graph:
        """Removes the facts with these s, p and o, whatever their frame."""
        return self._with(self.triples.join(facts.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti"))

    def forget_origin(self, *graphs: str) -> Graph:
        return self._with(self.triples.where(~F.coalesce(F.col("graph").isin(list(graphs)), F.lit(False))))

    def merge_frames(self, facts: DataFrame) -> Graph:
        """Adds facts and merges those of one s, p, o and agent whose intervals meet or overlap, whatever their flags: one is
        uncertain or occasional if a part is, has the least confidence, and no graph if its parts' graphs differ."""
        keys = ["s", "p", "o_kind", "o", "o_num", "agent"]
        both = self.triples.unionByName(framed(facts))
        hulls = merge_overlapping(both.select(*keys, "begin", "end"), keys, "begin", "end").withColumnsRenamed({"begin": "h_begin", "end": "h_end"})
        inside = F.coalesce(F.col("a.begin"), F.lit(-math.inf)).between(F.coalesce("h_begin", F.lit(-math.inf)), F.coalesce("h_end", F.lit(math.inf)))
        same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])
        parts = both.alias("a").join(hulls.alias("h"), same & inside).select("a.*", "h_begin", "h_end")
        merged = parts.groupBy(*keys, "h_begin", "h_end").agg(
            F.when((F.min("graph") == F.max("graph")) & (F.count("graph") == F.count("*")), F.min("graph")).alias("graph"), F.bool_or("uncertain").alias("uncertain"), F.min("confidence").alias("confidence"), F.bool_or("occasional").alias("occasional")
        )
        return self._with(merged.withColumnsRenamed({"h_begin": "begin", "h_end": "end"}).select(*self.triples.columns))

    def merge_tell(self, facts: DataFrame) -> Graph:
        """Adds facts and merges those of one s, p, o and agreeing flags whose intervals meet or overlap."""
        keys = ["s", "p", "o_kind", "o", "o_num", "graph", "agent", "uncertain", "confidence", "occasional"]
        return self._with(merge_overlapping(self.triples.unionByName(framed(facts)), keys, "begin", "end").select(*self.triples.columns))


def framed(facts: DataFrame) -> DataFrame:
    """Facts with all columns of TRIPLES."""
    kinds = dict(x.split() for x in TRIPLES.split(", "))
    given = {"o_kind": F.lit("lit"), "uncertain": F.lit(False), "occasional": F.lit(False), "o_num": F.expr("try_cast(o AS DOUBLE)"), "graph": F.lit("user")}
    return facts.select(*[(F.col(c) if c in facts.columns else given.get(c, F.lit(None))).cast(k).alias(c) for c, k in kinds.items()])


def to_reified(triples: DataFrame) -> DataFrame:
    """(s, p, o): each framed triple as a node with a fact for each part that is set."""
    node = F.concat(F.lit("stmt_"), F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ["s", "p", "o", *FIELDS]]), 256))
    parts = {"hasSubject": "s", "hasPredicate": "p", "hasObject": "o", "inGraph": "graph", "hasPerspective": "agent", "isUncertain": "uncertain", "hasConfidence": "confidence", "isOccasional": "occasional", "hasBegin": "begin", "hasEnd": "end"}
    pairs = F.explode(F.create_map(*[x for k, c in parts.items() for x in (F.lit(k), F.col(c).cast("string"))])).alias("p", "o")
    return triples.select(node.alias("s"), pairs).where("o IS NOT NULL")


def from_reified(facts: DataFrame) -> DataFrame:
    """The framed triples that to_reified took apart."""
    def part(k: str) -> Column:
        return F.max(F.when(F.col("p") == k, F.col("o")))

    rows = facts.groupBy("s").agg(
        part("hasSubject").alias("subject"), part("hasPredicate").alias("p"), part("hasObject").alias("o"), part("inGraph").alias("graph"), part("hasPerspective").alias("agent"), part("isUncertain").cast("boolean").alias("uncertain"),
        part("hasConfidence").cast("double").alias("confidence"), part("isOccasional").cast("boolean").alias("occasional"), part("hasBegin").cast("double").alias("begin"), part("hasEnd").cast("double").alias("end"),
    )
    return framed(rows.drop("s").withColumnRenamed("subject", "s"))
