"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.shared import materialize, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes; the fast built-in serves texts that are pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column of a batch as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def without(df: DataFrame, own: list[str]) -> list[str]:
    """The input's columns that an operator's own output columns don't replace."""
    return [c for c in df.columns if c not in own]


def wrapped(df: DataFrame, payload: str, own: list[str], *more: Column) -> DataFrame:
    """__row (a struct of the columns that stay, but for the payload), the payload, and more columns, for a Python operator."""
    keep = [c for c in df.columns if c != payload and c not in own]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row") if keep else F.lit(0).alias("__row"), payload, *more)


def unwrapped(done: DataFrame, df: DataFrame, payload: str, own: list[str]) -> DataFrame:
    """The columns of df again in their order, but for those named as the operator's own, which follow."""
    return done.select(*[F.col(c) if c == payload else F.col(f"__row.`{c}`") for c in df.columns if c not in own], *own)


_HELD: dict[str, Any] = {}  # what a Python worker keeps between the tasks of one stage


def _stage() -> int:
    context = TaskContext.get()
    return context.stageId() if context else -1


def held(name: str, make: Callable[[], Any]) -> Any:
    """An object that the tasks of a stage share in each worker, made once; tasks of another stage let it go."""
    if _HELD.get("stage") != _stage():
        _HELD.clear()
        _HELD["stage"] = _stage()
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _parts(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > rows or batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from _parts(batch.slice(0, half), rows, size)
        yield from _parts(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a task in small batches (bytes too, but for a row that is larger), so that few of them are Python objects at
    a time; then memory goes back."""
    if _HELD.get("stage") != _stage() and _HELD:
        _HELD.clear()
        release()
    for batch in batches:
        yield from _parts(batch, rows, size)
    release()


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield make(batch)

    return df.mapInArrow(run, schema)
