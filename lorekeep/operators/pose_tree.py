"""Poses of frames in their parents' frames, over time, composed along the tree of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import transforms as tf
from lorekeep.operators import intervals
from lorekeep.shared import materialize


def poses_at(samples: DataFrame, time: Column) -> DataFrame:
    """(child, parent, pose) at a time from samples (child, parent, pose, stamp): the latest of each child."""
    return intervals.value_at(samples, ["child"], ["parent", "pose"], "stamp", time).select("child", "parent", "pose")


def world_poses(tree: DataFrame, root: str | None = None, most_depth: int = 64) -> DataFrame:
    """(child, ancestor, pose, depth): the pose of every frame in the root, or in the topmost frame over it.

    Each round doubles the way that a frame's pose has been composed over, so that a tree of depth d takes log2 d joins.
    A frame in a cycle never gets to a top, and is left out.
    """
    up = tree.select("child", F.col("parent").alias("ancestor"), "pose", F.lit(1).alias("depth"))
    if root is not None:
        up = up.where(F.col("child") != root)
    known, done = materialize(up, "poses"), 1
    while True:
        a, b = known.alias("a"), known.alias("b")
        joined = a.join(b, F.col("a.ancestor") == F.col("b.child"), "left").select(
            F.col("a.child").alias("child"), F.coalesce("b.ancestor", "a.ancestor").alias("ancestor"),
            F.when(F.col("b.child").isNull(), F.col("a.pose")).otherwise(tf.multiply(F.col("b.pose"), F.col("a.pose"))).alias("pose"),
            (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"), F.col("b.child").isNotNull().alias("moved"),
        )
        known = materialize(joined, "poses")
        moved = known.where("moved").limit(1).count()
        known, done = known.drop("moved"), 2 * done
        if not moved or done > most_depth:
            top = known.select(F.col("child").alias("ancestor"))
            return known.join(top.distinct(), "ancestor", "left_anti").select("child", "ancestor", "pose", "depth")


def between_frames(world: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, pose): b's pose in a's frame, for pairs of frames under one top."""
    one, two = (world.select(F.col("child").alias(c), F.col("ancestor").alias("top"), F.col("pose").alias(f"pose_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, ["b", "top"])
    return both.select("a", "b", tf.between(F.col("pose_a"), F.col("pose_b")).alias("pose"))
