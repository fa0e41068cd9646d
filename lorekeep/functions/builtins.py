"""Arithmetic, text, list, term and type predicates as column functions. What has no value is null, never an error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANTS = {"pi": math.pi, "e": math.e, "epsilon": 2.220446049250313e-16, "inf": math.inf, "nan": math.nan}


# arithmetic; numbers are doubles
def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0)


def divide(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def modulo(x: Column, y: Column) -> Column:
    """The remainder, with the sign of the dividend; null for a zero divisor."""
    return F.when(y != 0, x % F.when(y != 0, y))


# text
def atom_number(text: Column) -> Column:
    return text.try_cast("double")


def number_atom(number: Column) -> Column:
    return number.cast("string")


def concat_left(right: Column, whole: Column) -> Column:
    """What stands before right in whole; null if whole doesn't end so."""
    return F.when(whole.endswith(right), F.substring(whole, F.lit(1), F.length(whole) - F.length(right)))


def concat_right(left: Column, whole: Column) -> Column:
    return F.when(whole.startswith(left), F.substring(whole, F.length(left) + 1, F.length(whole)))


def camel_case(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "[_ ]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def ensure_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.coalesce(concat_right(F.lit(prefix), text), text)


def ensure_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), text).otherwise(F.concat(text, F.lit(suffix)))


def remove_suffix(text: Column, suffix: str) -> Column:
    return F.coalesce(concat_left(F.lit(suffix), text), text)


def iri_namespace(iri: Column) -> Column:
    """The part up to and with the last #."""
    return F.nullif(F.regexp_extract(iri, "^(.*#)", 1), F.lit(""))


def iri_name(iri: Column) -> Column:
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1))


def new_iri(kind: str, *keys: Column) -> Column:
    """A name for an individual that depends on the keys only, so that a recomputed task gives the same."""
    return F.concat(F.lit(f"{kind}_"), F.sha2(F.concat_ws("\u0001", *[k.cast("string") for k in keys]), 256))


# lists
def nth0(array: Column, index: Column) -> Column:
    return F.when(index >= 0, F.get(array, index))


def index_of(array: Column, element: Column) -> Column:
    """Place of the first equal element, from 0; null if there is none."""
    return F.nullif(F.array_position(array, element), F.lit(0)) - 1


def sum_list(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))


def list_to_set(array: Column) -> Column:
    return F.array_distinct(array)


def sort_list(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def zip_lists(a: Column, b: Column) -> Column:
    return F.arrays_zip(a, b)


# terms: struct<functor: string, args: array<...>>
def term(functor: str, *args: Column) -> Column:
    return F.struct(F.lit(functor).alias("functor"), F.array(*args).alias("args"))


def functor(t: Column) -> Column:
    return t["functor"]


def arity(t: Column) -> Column:
    return F.size(t["args"])


def arg(t: Column, n: Column | int) -> Column:
    """The n-th argument, from 1."""
    return F.get(t["args"], (F.lit(n) if isinstance(n, int) else n) - 1)


def univ(t: Column) -> Column:
    """The functor and the arguments as one list of text."""
    return F.concat(F.array(t["functor"]), t["args"].cast("array<string>"))


# types
def is_number(value: Column) -> Column:
    return value.try_cast("double").isNotNull()


def is_atom(value: Column) -> Column:
    return value.isNotNull() & value.try_cast("double").isNull()


def literal_less(a: Column, b: Column) -> Column:
    """Numbers by value if both are numbers, else as text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x < y).otherwise(a < b)


# units: value, factor and offset to the base unit of each side
def convert_unit(value: Column, factor_in: Column, offset_in: Column, factor_out: Column, offset_out: Column) -> Column:
    return F.try_divide(value * factor_in + offset_in - offset_out, factor_out)
