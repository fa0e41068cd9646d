"""Control of goals. A goal is a function from bindings to bindings; these operators build goals from goals.

Where an operator works row by row (once, findall, negation …), rows with equal values in the ``key`` columns are one row.
Orders are explicit: the given columns, ascending, so that results don't depend on the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import bindings

Goal = Callable[[DataFrame], DataFrame]


def true(df: DataFrame) -> DataFrame:
    return df


def fail(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def where(test: Column) -> Goal:
    return lambda df: df.where(test)


def let(name: str, value: Column) -> Goal:
    return lambda df: bindings.bind(df, name, value)


def match(found: DataFrame) -> Goal:
    """Join with the answers of a pattern."""
    return lambda df: bindings.join(df, found)


def conj(*goals: Goal) -> Goal:
    return lambda df: reduce(lambda d, g: g(d), goals, df)


def disj(*goals: Goal, branch: str | None = None) -> Goal:
    """All solutions of all goals; ``branch`` names a column for the number of the goal, which is the order of solutions."""
    def run(df: DataFrame) -> DataFrame:
        return bindings.union(*(g(df).withColumn(branch, F.lit(i)) if branch else g(df) for i, g in enumerate(goals)))

    return run


def limit(goal: Goal, n: int, key: list[str], order: list[str]) -> Goal:
    """The first n solutions for each row of the input."""
    def run(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        return goal(df).withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")

    return run


def once(goal: Goal, key: list[str], order: list[str]) -> Goal:
    """The first solution for each row: an aggregate, so that a hot key is combined before the shuffle."""
    def run(df: DataFrame) -> DataFrame:
        found = goal(df)
        rest = [c for c in found.columns if c not in key and c not in order]
        best = F.min(F.struct(*order, *rest)).alias("__best")
        return found.groupBy(*key).agg(best).select(*key, *[F.col(f"__best.{c}").alias(c) for c in found.columns if c not in key])

    return run


def ignore(goal: Goal, key: list[str], order: list[str]) -> Goal:
    """The first solution, or the row itself with the goal's variables unbound."""
    return lambda df: df.join(once(goal, key, order)(df).drop(*[c for c in df.columns if c not in key]), key, "left")


def naf(goal: Goal, key: list[str]) -> Goal:
    """Negation as failure: rows for which the goal has no solution."""
    return lambda df: df.join(goal(df).select(*key).distinct(), key, "left_anti")


def if_then_else(test: Goal, then: Goal, other: Goal, key: list[str], order: list[str]) -> Goal:
    """then behind the test's first solution; other for rows without one."""
    return lambda df: bindings.union(then(once(test, key, order)(df)), other(naf(test, key)(df)))


def first_branch(*goals: Goal, key: list[str], order: list[str]) -> Goal:
    """Goals with a cut behind each: the first solution of the first goal that has one."""
    return once(disj(*goals, branch="__branch"), key, ["__branch", *order])


def findall(goal: Goal, template: Column, name: str, key: list[str], order: list[str]) -> Goal:
    """Each row with the list of the template over all solutions, in order; the empty list if there is none."""
    def run(df: DataFrame) -> DataFrame:
        item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], template.alias("item"))
        lists = goal(df).groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("__all")).select(*key, F.col("__all.item").alias(name))
        kind = lists.schema[name].dataType
        return df.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))

    return run


def member(array: str, name: str) -> Goal:
    """A row for each element of a list."""
    return lambda df: df.withColumn(name, F.explode(array))


def between(low: Column, high: Column, name: str) -> Goal:
    """A row for each whole number from low to high, none if high is less; where the name is bound, a test."""
    return lambda df: df.where(F.col(name).between(low, high)) if name in df.columns else df.withColumn(name, F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))


def aggregate(goal: Goal, by: list[str], **values: Column) -> Goal:
    """Aggregates over a goal's solutions, by variables."""
    return lambda df: goal(df).groupBy(*by).agg(*[v.alias(k) for k, v in values.items()])
