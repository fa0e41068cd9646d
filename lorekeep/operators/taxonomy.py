"""Transitive relations, class hierarchies and similarity of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.shared import materialize


def reach(edges: DataFrame, reflexive: bool = False, start: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): all nodes reached over edges (src, dst), each once, with its least depth.

    Semi-naive: each round extends only the pairs that the last one found and drops those known, so cycles end. ``start``
    (src) limits the sources. Reflexive adds every node, or every start, at depth 0.
    """
    edges = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    first = edges if start is None else edges.join(start.select("src").distinct(), "src", "left_semi")
    if reflexive:
        nodes = start.select("src").distinct() if start is not None else edges.select("src").union(edges.select("dst")).distinct()
        known = materialize(nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth")), "reach")
        found = first.join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        parts, new = [known], materialize(found.withColumn("depth", F.lit(1)), "reach")
    else:
        parts, new = [], materialize(first.withColumn("depth", F.lit(1)), "reach")
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while new.limit(1).count():
        parts.append(new)
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        ahead = new.join(step, "dst").select("src", F.col("next").alias("dst"), (F.col("depth") + 1).alias("depth")).dropDuplicates(["src", "dst"])
        new = materialize(ahead.join(known.select("src", "dst"), ["src", "dst"], "left_anti"), "reach")
    out = parts[0] if parts else new
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): all pairs on a path, without depths. Each round joins what is known with itself, so that a path of length n
    takes log2 n rounds; for long chains."""
    known = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "closure")
    while True:
        ahead = known.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        longer = known.join(ahead, "dst").select("src", F.col("next").alias("dst")).distinct()
        new = materialize(longer.join(known, ["src", "dst"], "left_anti"), "closure")
        if not new.limit(1).count():
            return known
        known = known.unionByName(new)


def least_common(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lcs, depth_a, depth_b): for each pair the common ancestor of least total distance, ties to the least name.

    closure is reach(…, reflexive=True) over subclass edges.
    """
    up = closure.select(F.col("src"), F.col("dst").alias("lcs"), "depth")
    a = pairs.join(up.withColumnsRenamed({"src": "a", "depth": "depth_a"}), "a")
    both = a.join(up.withColumnsRenamed({"src": "b", "depth": "depth_b"}), ["b", "lcs"])
    best = F.min(F.struct((F.col("depth_a") + F.col("depth_b")).alias("d"), "lcs", "depth_a", "depth_b")).alias("m")
    return both.groupBy("a", "b").agg(best).select("a", "b", "m.lcs", "m.depth_a", "m.depth_b")


def wu_palmer(closure: DataFrame, pairs: DataFrame, root: str) -> DataFrame:
    """(a, b, similarity): twice the depth of the least common ancestor by the sum of the paths' depths through it."""
    deep = closure.where(F.col("dst") == root).select(F.col("src").alias("lcs"), F.col("depth").alias("d"))
    found = least_common(closure, pairs).join(deep, "lcs")
    return found.select("a", "b", (2.0 * F.col("d") / (F.col("depth_a") + F.col("depth_b") + 2.0 * F.col("d"))).alias("similarity"))


def most_similar(similarities: DataFrame, n: int) -> DataFrame:
    """The n most similar b of each a, ties by name."""
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return similarities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
