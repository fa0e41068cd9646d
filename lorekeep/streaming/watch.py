"""Streams of facts: watching patterns, materialising rules as facts come, and logging poses that moved enough."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.rules import Rule, fire


def facts_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def watch(stream: DataFrame, pattern: dict[str, Any], call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls back with each batch of new facts that equal the pattern's columns; each batch once, by its number."""
    found = stream
    for column, value in pattern.items():
        found = found.where(F.col(column) == F.lit(value))
    return found.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def materialise(stream: DataFrame, rules: list[Rule], store: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to the store, and what the rules conclude from it together with what is there: the batch is the rules'
    first delta, so that old facts aren't fired again. A batch that runs again after a failure writes its own folder anew."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{store}/batch={number}"
        batch.select("s", "p", "o").distinct().write.mode("overwrite").parquet(path)
        known = spark.read.schema("s string, p string, o string, batch long").option("basePath", store).parquet(store).where(F.col("batch") <= number).select("s", "p", "o")
        fire(known, rules, new=spark.read.schema("s string, p string, o string").parquet(path)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


POSE = ["x", "y", "z", "qx", "qy", "qz", "qw"]


def moved(poses: DataFrame, key: str = "frame", distance: float = 0.001, seconds: float = 0.1, angle: float = 0.001) -> DataFrame:
    """Samples (key, parent, ts double, x, y, z, qx, qy, qz, qw) that differ from the last one kept by more than a distance, an
    angle (radians) or a time, or in the parent frame; one state row a key.

    Columns of the rotation or the parent that the input lacks count as unturned, and as one parent. Samples of a key are
    taken in order of time in each batch.
    """
    given = {"parent": F.lit(""), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.lit(1.0)}
    names = ["parent", "ts", *POSE]
    schema = "parent string, ts double, " + ", ".join(f"{c} double" for c in POSE)

    def far(now: tuple, last: tuple) -> bool:
        gap = sum((a - b) ** 2 for a, b in zip(now[2:5], last[2:5], strict=True))
        turn = 2 * math.acos(min(1.0, abs(sum(a * b for a, b in zip(now[5:], last[5:], strict=True)))))
        return now[0] != last[0] or now[1] - last[1] > seconds or gap > distance**2 or turn > angle

    def keep(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", *POSE])[names].itertuples(index=False):
            now = tuple(row)
            if last is None or far(now, last):
                out.append((group[0], *now))
                last = now
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[key, *names])

    rows = poses.select(key, *[F.col(c) if c in poses.columns else given[c].alias(c) for c in names])
    return rows.groupBy(key).applyInPandasWithState(keep, f"{key} string, {schema}", schema, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; a watermark closes windows and drops what comes later."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
