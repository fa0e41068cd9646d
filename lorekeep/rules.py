"""Forward rules over facts (s, p, o): semi-naive, until nothing new comes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import bindings
from lorekeep.shared import materialize
from lorekeep.terms import Op, is_var

Atom = tuple[object, str, object]


@dataclass
class Rule:
    """If all atoms of the body hold and ``where`` keeps the answer, the head's facts hold. Atoms are (s, p, o) with
    variables "?x", constants or operators; ``where`` may filter the bindings and bind more variables."""

    body: list[Atom]
    head: list[Atom]
    where: Callable[[DataFrame], DataFrame] | None = None
    absent: list[Atom] | None = None


def solve(facts: DataFrame, atom: Atom) -> DataFrame:
    """The bindings of an atom; a variable that stands twice must have one value."""
    s, p, o = atom
    tests, out = [F.col("p") == p, F.col("s").isNotNull(), F.col("o").isNotNull()], {}
    for term, column in ((s, F.col("s")), (o, F.col("o"))):
        var = term.var if isinstance(term, Op) else term if is_var(term) else None
        if isinstance(term, Op):
            tests.append(term.test(column.try_cast("double") if isinstance(term.value, int | float) else column))
        elif var is None:
            tests.append(column == F.lit(term))
        if var and var[1:] in out:
            tests.append(out[var[1:]] == column)
        elif var:
            out[var[1:]] = column
    found = facts
    for test in tests:
        found = found.where(test)
    return found.select(*[c.alias(v) for v, c in out.items()])


def may_give(head: Atom, atom: Atom) -> bool:
    """Whether a head's facts may match an atom: no two constants in it differ."""
    def open_(t: object) -> bool:
        return isinstance(t, Op) or is_var(t)

    return head[1] == atom[1] and all(open_(x) or open_(y) or x == y for x, y in ((head[0], atom[0]), (head[2], atom[2])))


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """The rules in groups, so that what an absent atom asks for is complete before; ValueError where that can't be."""
    level = [0] * len(rules)
    for _ in range(len(rules) + 1):
        before = list(level)
        for i, rule in enumerate(rules):
            for j, other in enumerate(rules):
                if any(may_give(h, a) for h in other.head for a in rule.absent or []):
                    level[i] = max(level[i], level[j] + 1)
                if any(may_give(h, a) for h in other.head for a in rule.body):
                    level[i] = max(level[i], level[j])
        if level == before:
            return [[r for r, k in zip(rules, level, strict=True) if k == n] for n in sorted(set(level))]
    raise ValueError("a rule depends on the absence of what it leads to")


def consequences(facts: DataFrame, rule: Rule, new: DataFrame | None = None, fresh: set[str] | None = None) -> DataFrame | None:
    """(s, p, o) of one application. With ``new``, answers that use a new fact: one join a body atom whose predicate is among
    the new facts' (``fresh``); None if no atom's is."""
    answers = []
    for i in [j for j, a in enumerate(rule.body) if fresh is None or a[1] in fresh] if new is not None else [-1]:
        found = None
        for j, atom in enumerate(rule.body):
            part = solve(new if i == j else facts, atom)
            found = part if found is None else bindings.join(found, part)
        answers.append(found)
    if not answers:
        return None
    found = bindings.union(*answers)
    for atom in rule.absent or []:
        found = bindings.negation(found, solve(facts, atom))
    found = rule.where(found) if rule.where else found

    def column(term: object) -> F.Column:
        return (F.col(term[1:]) if is_var(term) else F.lit(term)).cast("string")

    heads = [found.select(column(s).alias("s"), F.lit(p).alias("p"), column(o).alias("o")) for s, p, o in rule.head]
    return bindings.union(*heads).distinct()


def fire(facts: DataFrame, rules: list[Rule], new: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """The facts that rules add, (s, p, o). Strata go one after another; in each, a round applies rules to what the last one
    added, until nothing is. With ``new`` (part of the facts) only what follows from these is sought, unless atoms must be
    absent. Rules that make values without end are stopped by ``most_rounds``."""
    known = materialize(facts.select("s", "p", "o").distinct(), "facts")
    added: list[DataFrame] = []

    def names(df: DataFrame) -> set[str]:
        return {r.p for r in df.select("p").distinct().collect()}  # predicates in rules' heads, or of a batch

    seeds = new.select("s", "p", "o").distinct() if new is not None and not any(r.absent for r in rules) else None
    for group in strata(rules):
        delta = seeds
        for _ in range(most_rounds):
            fresh = names(delta) if delta is not None else None
            parts = [c for r in group if (c := consequences(known, r, delta, fresh)) is not None]
            if not parts:
                break
            delta = materialize(bindings.union(*parts).distinct().join(known, ["s", "p", "o"], "left_anti"), "new-facts")
            if not delta.limit(1).count():
                break
            added.append(delta)
            known = known.unionByName(delta)
            seeds = seeds.unionByName(delta) if seeds is not None else None
        else:
            raise RuntimeError(f"no end after {most_rounds} rounds")
    return bindings.union(*added) if added else known.limit(0)


def backward(facts: DataFrame, rules: list[Rule], atom: Atom) -> DataFrame:
    """The bindings of an atom from facts and rules, of which only those fire that can lead to it."""
    wanted, open_ = [], [atom]
    while open_:
        a = open_.pop()
        for rule in rules:
            if rule not in wanted and any(may_give(h, a) for h in rule.head):
                wanted.append(rule)
                open_ += [*rule.body, *(rule.absent or [])]
    rows = facts.select("s", "p", "o")
    return solve(rows.unionByName(fire(rows, wanted)) if wanted else rows, atom).distinct()


def restructure(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Facts in another structure: each rule, in order, replaces what its body matches by its head's facts."""
    facts = facts.select("s", "p", "o")
    for rule in rules:
        made = consequences(facts, rule)
        found = None
        for a in rule.body:
            part = solve(facts, a)
            found = part if found is None else bindings.join(found, part)
        found = rule.where(found) if rule.where else found

        def column(term: object) -> F.Column:
            term = term.var if isinstance(term, Op) else term
            return F.col(term[1:]) if is_var(term) else F.lit(term)

        used = bindings.union(*(found.select(column(s).alias("s"), F.lit(p).alias("p"), column(o).alias("o")) for s, p, o in rule.body)).distinct()
        facts = facts.join(used, ["s", "p", "o"], "left_anti").unionByName(made)
    return facts


def replacement(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a reasoner that replaces its conclusions adds and withdraws."""
    return after.select("s", "p", "o").exceptAll(before.select("s", "p", "o")), before.select("s", "p", "o").exceptAll(after.select("s", "p", "o"))
