"""Formulas: patterns under conjunction, disjunction, negation, implication and modality, as values that become one DataFrame.

``P("Fred", "hasSibling", "?x") & ~P("?x", "hasNumber", "?n")`` is written ``And(...)`` and so on; ``answers`` gives its bindings,
``holds`` yes, no or unknown, ``explain`` the facts behind each answer.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.graph import Graph, UnknownPredicate
from lorekeep.operators import bindings
from lorekeep.terms import Frame, Op, Pattern, always, believe, is_var, know, sometimes


class Formula:
    def __and__(self, other: Formula) -> Formula:
        return And((self, other))

    def __or__(self, other: Formula) -> Formula:
        return Or((self, other))

    def __invert__(self) -> Formula:
        return Not(self)

    def __rshift__(self, other: Formula) -> Formula:
        return Or((Not(self), other))


@dataclass(frozen=True)
class Fact(Formula):
    pattern: Pattern


@dataclass(frozen=True)
class And(Formula):
    parts: tuple[Formula, ...]


@dataclass(frozen=True)
class Or(Formula):
    parts: tuple[Formula, ...]


@dataclass(frozen=True)
class Not(Formula):
    part: Formula


@dataclass(frozen=True)
class Modal(Formula):
    """K, B, H or P over a formula: ``kind`` with an agent and a confidence, or with an interval."""

    kind: str
    part: Formula
    agent: str | None = None
    confidence: float | None = None
    begin: float | None = None
    end: float | None = None

    def frame(self, outer: Frame) -> Frame:
        return {
            "K": lambda: know(outer, self.agent), "B": lambda: believe(outer, self.agent, self.confidence), "H": lambda: always(outer, self.begin, self.end), "P": lambda: sometimes(outer, self.begin, self.end),
        }[self.kind]()


def fact(s: object, p: str, o: object) -> Fact:
    return Fact(Pattern(s, p, o))


def variables(formula: Formula) -> list[str]:
    if isinstance(formula, Fact):
        return formula.pattern.variables()
    parts = formula.parts if isinstance(formula, And | Or) else (formula.part,)
    return list(dict.fromkeys(v for p in parts for v in variables(p)))


def substitute(formula: Formula, values: dict[str, object]) -> Formula:
    """The formula with values for some of its variables."""
    def term(t: object) -> object:
        return values.get(t[1:], t) if is_var(t) else replace(t, var=None) if isinstance(t, Op) and t.var and t.var[1:] in values else t

    if isinstance(formula, Fact):
        q = formula.pattern
        return Fact(Pattern(term(q.s), term(q.p), term(q.o), q.frame))
    if isinstance(formula, And | Or):
        return type(formula)(tuple(substitute(p, values) for p in formula.parts))
    return replace(formula, part=substitute(formula.part, values))


def answers(graph: Graph, formula: Formula, frame: Frame = Frame(), given: DataFrame | None = None) -> DataFrame:
    """The bindings of a formula; with ``given``, only those that continue these bindings.

    In a conjunction, what is positive is joined first, so that each part shares a variable with those before if one does;
    then negations drop answers. A negation by itself is one empty answer or none. A disjunction's branches may leave
    variables unbound, which then match anything.
    """
    if isinstance(formula, Fact):
        found = graph.match(replace(formula.pattern, frame=frame if frame != Frame() else formula.pattern.frame))
        return found if given is None else _joined(given, found)
    if isinstance(formula, Modal):
        return answers(graph, formula.part, formula.frame(frame), given)
    if isinstance(formula, Or):
        found = bindings.union(*(answers(graph, p, frame, given) for p in formula.parts))
        return found.distinct()
    if isinstance(formula, Not):
        left = given if given is not None else bindings.single(graph.spark)
        return bindings.negation(left, answers(graph, formula.part, frame))
    open_, left = [p for p in formula.parts if not isinstance(p, Not)], given
    while open_:
        nxt = next((p for p in open_ if left is not None and set(left.columns) & set(variables(p))), open_[0])
        open_.remove(nxt)
        found = answers(graph, nxt, frame)
        left = found if left is None else _joined(left, found)
    for p in formula.parts:
        if isinstance(p, Not):
            left = answers(graph, p, frame, left)
    return left


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    maybe = tuple(c for c in left.columns if c in right.columns and (left.schema[c].nullable or right.schema[c].nullable))
    return bindings.join(left, right, maybe)


def holds(graph: Graph, formula: Formula) -> str:
    """yes, no, or unknown where nothing is known of a predicate that decides."""
    if isinstance(formula, Or):
        found = {holds(graph, p) for p in formula.parts}
        return "yes" if "yes" in found else "unknown" if "unknown" in found else "no"
    try:
        for q in _patterns(formula):
            graph.known(q.p)
    except UnknownPredicate:
        return "unknown"
    return "yes" if answers(graph, formula).limit(1).count() else "no"


def _patterns(formula: Formula) -> list[Pattern]:
    if isinstance(formula, Fact):
        return [formula.pattern]
    return [q for p in (formula.parts if isinstance(formula, And | Or) else (formula.part,)) for q in _patterns(p)]


def explain(graph: Graph, formula: Formula) -> DataFrame:
    """The answers of a formula, each with ``because``: the facts of its positive patterns, with the answer's values."""
    def text(t: object, found: DataFrame) -> F.Column:
        name = t.var if isinstance(t, Op) else t
        return F.coalesce(F.col(name[1:]).cast("string"), F.lit(name)) if is_var(name) and name[1:] in found.columns else F.lit(str(t.value if isinstance(t, Op) else t))

    def positive(f: Formula) -> list[Pattern]:
        return [] if isinstance(f, Not) else [f.pattern] if isinstance(f, Fact) else [q for p in (f.parts if isinstance(f, And | Or) else (f.part,)) for q in positive(p)]

    found = answers(graph, formula)
    said = [F.concat(F.lit(f"{q.p}("), text(q.s, found), F.lit(", "), text(q.o, found), F.lit(")")) for q in positive(formula)]
    return found.withColumn("because", F.array(*said))


def all_of(*parts: Formula) -> Formula:
    return reduce(Formula.__and__, parts)
