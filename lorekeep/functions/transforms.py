"""Vectors, quaternions (x, y, z, w) and poses as struct columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: nested compositions then grow with their depth and don't double at each level."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), w.cast("double").alias("w"))


def add(a: Column, b: Column) -> Column:
    return vector(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def scale(a: Column, f: Column | float) -> Column:
    return vector(a["x"] * f, a["y"] * f, a["z"] * f)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(a["z"] - b["z"], 2))


def quaternion_multiply(p: Column, q: Column) -> Column:
    return quaternion(
        p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"], p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"],
        p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"], p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"],
    )


def conjugate(q: Column) -> Column:
    return quaternion(-q["x"], -q["y"], -q["z"], q["w"])


def rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q."""
    return let(q, lambda p: let(v, lambda u: _rotate(p, u)))


def _rotate(q: Column, v: Column) -> Column:
    tx, ty, tz = 2 * (q["y"] * v["z"] - q["z"] * v["y"]), 2 * (q["z"] * v["x"] - q["x"] * v["z"]), 2 * (q["x"] * v["y"] - q["y"] * v["x"])
    return vector(v["x"] + q["w"] * tx + q["y"] * tz - q["z"] * ty, v["y"] + q["w"] * ty + q["z"] * tx - q["x"] * tz, v["z"] + q["w"] * tz + q["x"] * ty - q["y"] * tx)


def pose(position: Column, rotation: Column) -> Column:
    return F.struct(position.alias("position"), rotation.alias("rotation"))


def multiply(a: Column, b: Column) -> Column:
    """Pose b, given in a's frame, in the frame of a's parent."""
    return let(a, lambda x: let(b, lambda y: pose(add(x["position"], rotate(x["rotation"], y["position"])), quaternion_multiply(x["rotation"], y["rotation"]))))


def invert(a: Column) -> Column:
    return let(a, lambda x: let(conjugate(x["rotation"]), lambda back: pose(scale(rotate(back, x["position"]), -1.0), back)))


def between(a: Column, b: Column) -> Column:
    """Pose b in a's frame, both given in one frame."""
    return multiply(invert(a), b)


def angle(p: Column, q: Column) -> Column:
    dot = p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"] + p["w"] * q["w"]
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot)))


def slerp(p: Column, q: Column, t: Column) -> Column:
    dot = p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"] + p["w"] * q["w"]
    sign, theta = F.when(dot < 0, -1.0).otherwise(1.0), F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = theta < 1e-6
    a = F.when(near, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * theta), F.sin(theta)))
    b = sign * F.when(near, t).otherwise(F.try_divide(F.sin(t * theta), F.sin(theta)))
    return quaternion(*(a * p[c] + b * q[c] for c in "xyzw"))


def interpolate(a: Column, b: Column, t: Column) -> Column:
    return pose(add(scale(a["position"], 1 - t), scale(b["position"], t)), slerp(a["rotation"], b["rotation"], t))


def close_to(a: Column, b: Column, distance_bound: float, angle_bound: float) -> Column:
    return (distance(a["position"], b["position"]) <= distance_bound) & (angle(a["rotation"], b["rotation"]) <= angle_bound)


# spatial relations of positions, and of boxes given by their sizes
def on_top(a: Column, b: Column, gap: float = 0.05) -> Column:
    return (a["z"] - b["z"] >= 0) & (a["z"] - b["z"] <= gap)


def above(a: Column, b: Column) -> Column:
    return a["z"] > b["z"]


def centred(a: Column, b: Column, slack: float = 0.2) -> Column:
    return (F.abs(a["x"] - b["x"]) <= slack) & (F.abs(a["y"] - b["y"]) <= slack) & (F.abs(a["z"] - b["z"]) <= slack)


def contains(outer: Column, outer_size: Column, inner: Column, inner_size: Column) -> Column:
    test = F.lit(True)
    for c in "xyz":
        test &= (outer[c] - outer_size[c] / 2 <= inner[c] - inner_size[c] / 2) & (inner[c] + inner_size[c] / 2 <= outer[c] + outer_size[c] / 2)
    return test
