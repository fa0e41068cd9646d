"""Stored relations of any number of columns, fluents (relations that change over time) and annotations, as DataFrames.

Each operation gives a new value; what is written where is up to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import intervals
from lorekeep.terms import Op, is_var


def _test(columns: list[str], terms: tuple[object, ...]) -> tuple[Column, dict[str, Column]]:
    """The filter for terms (constants, operators, variables) by column, and the variables' columns."""
    tests, out = [F.lit(True)], {}
    for term, name in zip(terms, columns, strict=True):
        column = F.col(name)
        var = term.var if isinstance(term, Op) else term if is_var(term) else None
        if isinstance(term, Op):
            tests.append(term.test(column))
        elif var is None:
            tests.append(column == F.lit(term))
        if var and var[1:] in out:
            tests.append(out[var[1:]] == column)
        elif var:
            out[var[1:]] = column
    return reduce(Column.__and__, tests), out


@dataclass(frozen=True)
class Relation:
    """Rows of named columns; a column may be a struct, which stands for a term with arguments."""

    rows: DataFrame

    @staticmethod
    def declare(spark: SparkSession, schema: str) -> Relation:
        return Relation(spark.createDataFrame([], schema))

    def ask(self, *terms: object) -> DataFrame:
        """The bindings of the terms' variables."""
        test, out = _test(self.rows.columns, terms)
        return self.rows.where(test).select(*[c.alias(v) for v, c in out.items()])

    def tell(self, rows: DataFrame) -> Relation:
        return Relation(self.rows.unionByName(rows.select(*self.rows.columns)).distinct())

    def forget(self, *terms: object) -> Relation:
        """Without the rows that match; rows with a null where a term tests stay."""
        test, _ = _test(self.rows.columns, terms)
        return Relation(self.rows.where(~F.coalesce(test, F.lit(False))))


def annotations(spark: SparkSession) -> Relation:
    """Texts about things, apart from the facts: (s, p, text)."""
    return Relation.declare(spark, "s string, p string, text string")


@dataclass(frozen=True)
class Fluent:
    """Values of keys that hold from their time to the next value's, the last one for ever; a sample may say that none holds."""

    samples: DataFrame  # keys, values, time, gone (boolean)
    keys: tuple[str, ...]
    values: tuple[str, ...]
    time: str = "time"

    @staticmethod
    def declare(spark: SparkSession, keys: str, values: str, time: str = "time double") -> Fluent:
        def names(schema: str) -> tuple[str, ...]:
            return tuple(c.split()[0] for c in schema.split(", "))

        return Fluent(spark.createDataFrame([], f"{keys}, {values}, {time}, gone boolean"), names(keys), names(values), time.split()[0])

    def tell(self, rows: DataFrame) -> Fluent:
        """Values from their times on; told again, they are told once."""
        own = [*self.keys, *self.values, self.time]
        return replace(self, samples=self.samples.unionByName(rows.select(*own, F.lit(False).alias("gone"))).distinct())

    def forget(self, rows: DataFrame) -> Fluent:
        """Without the samples that have these keys and values (a null only where it is null), so that what held before holds on."""
        same = [c for c in (*self.keys, *self.values, self.time) if c in rows.columns]
        equal = reduce(Column.__and__, [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in same])
        return replace(self, samples=self.samples.alias("s").join(rows.select(*same).distinct().alias("r"), equal, "left_anti"))

    def end(self, rows: DataFrame) -> Fluent:
        """From a time on the keys have no value."""
        none = [F.lit(None).cast(self.samples.schema[v].dataType).alias(v) for v in self.values]
        return replace(self, samples=self.samples.unionByName(rows.select(*self.keys, *none, self.time, F.lit(True).alias("gone"))).distinct())

    def at(self, time: Column) -> DataFrame:
        """(keys, values) at a time. Tests of values belong behind it, when the latest sample is chosen."""
        held = intervals.value_at(self.samples, list(self.keys), ["gone", *self.values], self.time, time)
        return held.where("NOT gone").select(*self.keys, *self.values)

    def within(self, begin: Column, end: Column) -> DataFrame:
        """(keys, values, valid_from, valid_to) of all that holds somewhere in an interval, cut to it."""
        held = intervals.values_in(self.samples, list(self.keys), self.time, begin, end)
        return held.where("NOT gone").select(*self.keys, *self.values, "valid_from", "valid_to")
