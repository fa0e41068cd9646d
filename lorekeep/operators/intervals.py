"""Time intervals: Allen's relations, joins over common time, merging of overlaps, and fluents (values that hold from their
time stamp to the next)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = math.inf


def allen(relation: str, b0: Column, e0: Column, b1: Column, e1: Column) -> Column:
    """Whether interval 0 stands in the relation to interval 1; during includes equal ends."""
    return {
        "equals": (b0 == b1) & (e0 == e1), "before": e0 < b1, "after": e1 < b0, "meets": e0 == b1, "met_by": e1 == b0, "starts": (b0 == b1) & (e0 < e1),
        "started_by": (b0 == b1) & (e1 < e0), "finishes": (b0 > b1) & (e0 == e1), "finished_by": (b1 > b0) & (e0 == e1),
        "overlaps": (b0 < b1) & (b1 < e0) & (e0 < e1), "overlapped_by": (b1 < b0) & (b0 < e1) & (e1 < e0), "during": (b1 <= b0) & (e0 <= e1),
    }[relation]


RELATIONS = ["equals", "before", "after", "meets", "met_by", "starts", "started_by", "finishes", "finished_by", "overlaps", "overlapped_by", "during"]


def since(begin: Column, end: Column, t: float, now: float) -> Column:
    """Whether a fact holds from t until now."""
    return (F.coalesce(begin, F.lit(-INF)) <= t) & (F.coalesce(end, F.lit(INF)) >= now)


def until(begin: Column, end: Column, t: float) -> Column:
    """Whether a fact holds before and up to t."""
    return (F.coalesce(begin, F.lit(-INF)) <= t) & (F.coalesce(end, F.lit(INF)) >= t)


def during(begin: Column, end: Column, b: Column | float, e: Column | float) -> Column:
    """Whether a fact holds throughout [b, e]."""
    return (F.coalesce(begin, F.lit(-INF)) <= b) & (F.coalesce(end, F.lit(INF)) >= e)


def merge_overlapping(facts: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """One row for each run of intervals of a key that meet or overlap; an open side is null and stays open."""
    b, e = F.coalesce(F.col(begin), F.lit(-INF)), F.coalesce(F.col(end), F.lit(INF))
    order = Window.partitionBy(*keys).orderBy("__b", "__e")
    seen = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = facts.withColumn("__b", b).withColumn("__e", e).withColumn("__new", F.when(F.col("__b") <= seen, 0).otherwise(1))
    runs = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hull = runs.groupBy(*keys, "__run").agg(F.min("__b").alias("__b"), F.max("__e").alias("__e"))
    return hull.select(*keys, F.when(F.col("__b") > -INF, F.col("__b")).alias(begin), F.when(F.col("__e") < INF, F.col("__e")).alias(end))


def validity(samples: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Samples with valid_from and valid_to: a value holds until the next sample of its key, the last one for ever (null)."""
    rest = [c for c in samples.columns if c not in keys and c != time]  # samples of one time go by their other columns
    nxt = F.lead(time).over(Window.partitionBy(*keys).orderBy(time, *rest))
    return samples.withColumn("valid_from", F.col(time)).withColumn("valid_to", nxt)


def value_at(samples: DataFrame, keys: list[str], values: list[str], time: str, at: Column) -> DataFrame:
    """The latest sample of each key up to a time: a map-side aggregate, not a sort. Of samples at one time the greatest values
    count. Filters on values belong behind it."""
    latest = F.max(F.struct(time, *values))
    return samples.where(F.col(time) <= at).groupBy(*keys).agg(latest.alias("v")).select(*keys, "v.*")


def values_in(samples: DataFrame, keys: list[str], time: str, begin: Column, end: Column) -> DataFrame:
    """All samples that hold somewhere in [begin, end], with their validity cut to it."""
    held = validity(samples, keys, time).where((F.col("valid_from") <= end) & (F.col("valid_to").isNull() | (F.col("valid_to") > begin)))
    return held.withColumn("valid_from", F.greatest("valid_from", begin)).withColumn("valid_to", F.least(F.coalesce("valid_to", end), end))


def as_of_join(left: DataFrame, samples: DataFrame, keys: list[str], left_time: str, time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest sample of its key up to its time.

    Of samples at one time the one with the greatest values counts. Both sides are sorted together once; the last sample seen is carried forward. No row pairs arise, and a key's rows are
    spread over windows of keys only, so that one key's history is what a task holds.
    """
    payload = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*payload).alias("__row"), F.lit(None).cast(samples.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    b = samples.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*payload)).schema[0].dataType).alias("__row"), F.struct(*values).alias("__v"))
    order = Window.partitionBy(*keys).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("__last", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    return carried.select(*keys, "__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, most_slots: int = 64) -> DataFrame:
    """Pairs of rows (begin, end, each closed; null: open) of a key that share time, with the common interval.

    Each side is dealt once to slots of time; an equi-join on key and slot makes a pair in the slot where the later of the two
    begins. Slots have ``width`` at least, and four times the rows' mean length, so that a row lies in 1.25 slots on average; an
    open side ends at the last finite time. Rows of more than most_slots slots join by key alone. The sides' other columns must
    differ in name. The sides are read twice, so that costly ones should be stored before. Where both are one stored table with its
    other columns renamed on both sides, Spark deals it once for both.
    """
    rest = {n: [c for c in d.columns if c not in keys and c not in ("begin", "end")] for n, d in (("l", left), ("r", right))}
    begin, end = F.col("begin").cast("double"), F.col("end").cast("double")
    sides = {n: d.select(*keys, *rest[n], F.when(begin > -INF, begin).alias(f"{n}_begin"), F.when(end < INF, end).alias(f"{n}_end")) for n, d in (("l", left), ("r", right))}
    times = sides["l"].select(F.col("l_begin").alias("b"), F.col("l_end").alias("e")).unionByName(sides["r"].select(F.col("r_begin").alias("b"), F.col("r_end").alias("e")))
    t = times.agg(F.min(F.least("b", "e")).alias("lo"), F.max(F.greatest("b", "e")).alias("hi"), F.sum("b").alias("b"), F.sum("e").alias("e"), F.count("b").alias("n_b"), F.count("e").alias("n_e"), F.count("*").alias("n")).first()
    lo, hi = t.lo or 0.0, t.hi or 0.0
    length = ((t.e or 0.0) + hi * (t.n - t.n_e) - (t.b or 0.0) - lo * (t.n - t.n_b)) / max(t.n, 1)
    width = max(width, 4 * length)

    def slot(c: Column) -> Column:
        return F.floor(c / width)

    def split(name: str) -> tuple[DataFrame, DataFrame]:
        first, last = slot(F.coalesce(f"{name}_begin", F.lit(lo))), slot(F.coalesce(f"{name}_end", F.lit(hi)))
        short = last - first < most_slots
        return sides[name].where(short).withColumn("__slot", F.explode(F.sequence(first, F.greatest(first, last)))), sides[name].where(~short)

    (l_dealt, l_wide), (r_dealt, r_wide) = split("l"), split("r")
    meet = F.coalesce(F.col("l_begin") <= F.col("r_end"), F.lit(True)) & F.coalesce(F.col("r_begin") <= F.col("l_end"), F.lit(True))
    later = F.greatest(F.coalesce("l_begin", F.lit(lo)), F.coalesce("r_begin", F.lit(lo)))
    pairs = l_dealt.join(r_dealt, [*keys, "__slot"]).where(meet & (F.col("__slot") == slot(later))).drop("__slot")
    if (hi - lo) / width >= most_slots - 1:  # else no row is so long

        def by_key(a: DataFrame, b: DataFrame) -> DataFrame:
            return (a.join(b, keys) if keys else a.crossJoin(b)).where(meet)

        l_short = l_dealt.where(F.col("__slot") == slot(F.coalesce("l_begin", F.lit(lo)))).drop("__slot")
        pairs = pairs.unionByName(by_key(l_wide, sides["r"])).unionByName(by_key(l_short, r_wide))
    return pairs.withColumn("begin", F.greatest("l_begin", "r_begin")).withColumn("end", F.least("l_end", "r_end"))


def count_before(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many pairs of a key have the left interval end before the right one begins: one sort, no pairs. As in a join,
    a null key equals none; an end or begin that is null is before and after none."""

    def told(df: DataFrame, t: str) -> DataFrame:
        return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, t)))

    ends = told(left, "end").select(*keys, F.col("end").alias("t"), F.lit(1).alias("is_end"))
    begins = told(right, "begin").select(*keys, F.col("begin").alias("t"), F.lit(0).alias("is_end"))
    ahead = F.sum("is_end").over(Window.partitionBy(*keys).orderBy("t", "is_end").rowsBetween(Window.unboundedPreceding, -1))
    return ends.unionByName(begins).withColumn("n", F.coalesce(ahead, F.lit(0))).where("is_end = 0").groupBy(*keys).agg(F.sum("n").alias("n"))


# frames of answers: _begin and _end, null where open


def bind_during(answers: DataFrame, begin: str, end: str) -> DataFrame:
    """S during [B, E] with variables: they get the answer's interval, and must agree where they are bound."""
    b, e = F.coalesce("_begin", F.lit(-INF)), F.coalesce("_end", F.lit(INF))
    held = answers
    for name, value, fits in ((begin, b, F.col(begin) >= b if begin in answers.columns else None), (end, e, F.col(end) <= e if end in answers.columns else None)):
        held = held.withColumn(name, value) if fits is None else held.where(F.col(name).isNull() | fits).withColumn(name, F.coalesce(F.col(name), value))
    return held


def during_event(answers: DataFrame, events: DataFrame, event: str) -> DataFrame:
    """S during Event: answers that hold throughout an event (a column of ``events``, with begin and end). With the event bound
    in the answers it is a join by event, else one by overlap of time."""
    inside = (F.coalesce("_begin", F.lit(-INF)) <= F.coalesce("begin", F.lit(-INF))) & (F.coalesce("_end", F.lit(INF)) >= F.coalesce("end", F.lit(INF)))
    if event in answers.columns:
        return answers.join(events.select(event, "begin", "end"), event).where(inside).drop("begin", "end")
    return answers.join(events.select(event, "begin", "end"), inside).drop("begin", "end")


def occurs(events: DataFrame, now: Column | float) -> DataFrame:
    """The events that go on at a time."""
    return events.where((F.coalesce("begin", F.lit(-INF)) <= now) & (F.coalesce("end", F.lit(INF)) >= now))
