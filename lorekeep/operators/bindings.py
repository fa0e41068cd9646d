"""Bindings are DataFrames with a column for each variable; these operators combine them.

A variable is unbound where its column is null, which happens only behind optional parts and unions.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = ["_uncertain", "_occasional", "_confidence", "_begin", "_end", "_graph", "_agent"]


def variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in FRAME]


def join(left: DataFrame, right: DataFrame, maybe: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Conjunction: an equi-join on the shared variables, a cross join if there are none.

    Variables in ``maybe`` can be unbound on either side and then match anything and take the other's value: rows are split
    by what is bound, so that each part is an equi-join on the variables that both sides have bound. If both sides carry
    intervals, answers whose common interval is empty go; if both carry agents, so do those of different ones; the graph of
    an answer from two graphs is unset.
    """
    shared = [c for c in variables(left) if c in right.columns]
    maybe = tuple(c for c in shared if c in maybe)
    if maybe:
        parts = [_join(a, b, tuple(c for c in shared if c not in keys), maybe, "inner") for a, b, keys in _split(left, right, shared, maybe)]
        found = reduce(DataFrame.unionByName, parts)
        return union(found, negation(left, right, maybe)) if how == "left" else found
    return _join(left, right, (), (), how)


def _split(left: DataFrame, right: DataFrame, shared: list[str], maybe: tuple[str, ...]) -> list[tuple[DataFrame, DataFrame, list[str]]]:
    """Both sides by which of the variables in maybe are bound, and the shared variables bound on both: 4 parts for one such
    variable, 16 for two."""
    def part(df: DataFrame, bound: tuple[bool, ...]) -> DataFrame:
        return df.where(reduce(Column.__and__, [F.col(c).isNotNull() if x else F.col(c).isNull() for c, x in zip(maybe, bound, strict=True)]))

    masks = list(product([True, False], repeat=len(maybe)))
    return [(part(left, x), part(right, y), [c for c in shared if c not in maybe or x[maybe.index(c)] and y[maybe.index(c)]]) for x in masks for y in masks]


def _join(left: DataFrame, right: DataFrame, free: tuple[str, ...], maybe: tuple[str, ...], how: str) -> DataFrame:
    shared = [c for c in variables(left) if c in right.columns]
    a, b = left.alias("a"), right.alias("b")
    tests = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in shared if c not in free]
    timed = all({"_begin", "_end"} <= set(d.columns) for d in (left, right))
    if timed:  # comparisons with an open end are null-free: least and greatest skip nulls
        begin, end = F.greatest("a._begin", "b._begin"), F.least("a._end", "b._end")
        tests.append(F.coalesce(begin < end, F.lit(True)))
    if all("_agent" in d.columns for d in (left, right)):
        tests.append(F.col("a._agent").eqNullSafe(F.col("b._agent")))
    joined = a.join(b, reduce(Column.__and__, tests), how) if tests else a.crossJoin(b)
    columns = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in maybe else F.col(f"a.{c}").alias(c) for c in shared]
    columns += [F.col(f"a.{c}") for c in variables(left) if c not in shared] + [F.col(f"b.{c}") for c in variables(right) if c not in shared]
    frame = {"_uncertain": lambda x, y: F.coalesce(x | y, x, y), "_occasional": lambda x, y: F.coalesce(x | y, x, y), "_confidence": F.least, "_begin": F.greatest, "_end": F.least, "_agent": lambda x, y: x, "_graph": lambda x, y: F.when(x == y, x)}
    for c in FRAME:
        held = [F.col(f"{n}.{c}") for n, d in (("a", left), ("b", right)) if c in d.columns]
        columns += [(frame[c](*held) if len(held) == 2 else held[0]).alias(c)] if held else []
    return joined.select(*columns)


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join: the right side's own variables stay unbound where nothing matches."""
    return join(left, right, how="left")


def negation(left: DataFrame, right: DataFrame, maybe: tuple[str, ...] | None = None) -> DataFrame:
    """Answers of the left side for which the right side has none; without shared variables, all or nothing.

    Variables in ``maybe`` can be unbound and then match anything; by default those that the schemas allow to be null.
    """
    shared = [c for c in variables(left) if c in right.columns]
    if not shared:
        return left.join(right.limit(1).select(F.lit(1).alias("__found")), F.lit(True), "left_anti")
    maybe = _nullable(left, right, shared) if maybe is None else tuple(c for c in shared if c in maybe)
    if not maybe:
        return left.join(right.select(*shared).distinct(), shared, "left_anti")
    left_parts: dict[int, DataFrame] = {}
    for i, (a, b, keys) in enumerate(_split(left, right, shared, maybe)):
        at = i >> len(maybe)
        left_parts[at] = negation(left_parts.get(at, a), b.select(*keys, *([F.lit(1).alias("__any")] if not keys else [])), ())
    return reduce(DataFrame.unionByName, left_parts.values())


def _nullable(left: DataFrame, right: DataFrame, shared: list[str]) -> tuple[str, ...]:
    return tuple(c for c in shared if left.schema[c].nullable or right.schema[c].nullable)


def semi(left: DataFrame, right: DataFrame, maybe: tuple[str, ...] | None = None) -> DataFrame:
    """Answers of the left side that the right side confirms, each once; unbound variables as in ``negation``."""
    shared = [c for c in variables(left) if c in right.columns]
    maybe = _nullable(left, right, shared) if maybe is None else tuple(c for c in shared if c in maybe)
    if not maybe or not shared:
        return left.join(right.select(*shared).distinct(), shared, "left_semi") if shared else left.join(right.limit(1).select(F.lit(1).alias("__found")), F.lit(True), "left_semi")
    parts: dict[int, list[DataFrame]] = {}
    for i, (a, b, keys) in enumerate(_split(left, right, shared, maybe)):
        done = parts.setdefault(i >> len(maybe), [a])
        hit = semi(done[0], b.select(*keys), ())
        done[0] = negation(done[0], b.select(*keys, *([F.lit(1).alias("__any")] if not keys else [])), ())
        done.append(hit)
    return reduce(DataFrame.unionByName, [d for done in parts.values() for d in done[1:]])


def union(*branches: DataFrame) -> DataFrame:
    """Disjunction, with duplicates; variables that a branch lacks are unbound there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def intersection(*branches: DataFrame) -> DataFrame:
    """Answers that all branches give, each once."""
    return reduce(lambda a, b: a.select(*b.columns).intersect(b), branches)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Binds a variable; if it is bound already, the values must agree."""
    if name not in df.columns:
        return df.withColumn(name, value)
    return df.where(F.col(name).isNull() | F.col(name).eqNullSafe(value)).withColumn(name, F.coalesce(F.col(name), value))


def compare(df: DataFrame, left: Column, op: str, right: Column, optional_sides: bool = False) -> DataFrame:
    """Keeps rows with left op right; with optional_sides also those where a side is unbound."""
    test = {"less": left < right, "lessOrEqual": left <= right, "greater": left > right, "greaterOrEqual": left >= right, "equal": left == right, "notEqual": left != right}[op]
    return df.where(left.isNull() | right.isNull() | test if optional_sides else test)


def single(spark) -> DataFrame:
    """The one empty answer, from which goals start."""
    return spark.range(1).select()
