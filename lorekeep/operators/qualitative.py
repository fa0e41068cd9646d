"""Relations of intervals of which only relations are told: a graph of end points, in which a path means "before".

Facts are (a, relation, b). Each says which ends are equal and which come first; equal ends are one node (connected
components), and the closure of "first" answers any relation of two intervals that follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.intervals import RELATIONS
from lorekeep.operators.taxonomy import closure
from lorekeep.shared import materialize

# Allen's relations by ends (b, e: of the first, B, E: of the second), equal ends and earlier ones.
EQUAL = {"equals": ["bB", "eE"], "meets": ["eB"], "met_by": ["bE"], "starts": ["bB"], "started_by": ["bB"], "finishes": ["eE"], "finished_by": ["eE"]}
FIRST = {
    "before": ["eB"], "after": ["Eb"], "starts": ["eE"], "started_by": ["Ee"], "finishes": ["Bb"], "finished_by": ["bB"], "overlaps": ["bB", "Be", "eE"],
    "overlapped_by": ["Bb", "bE", "Ee"], "during": ["Bb", "eE"], "contains": ["bB", "Ee"],
}


def _ends(facts: DataFrame, table: dict[str, list[str]]) -> DataFrame:
    """(src, dst): nodes as name and b or e."""
    names = F.create_map(*[x for k, pairs in table.items() for x in (F.lit(k), F.array(*map(F.lit, pairs)))])
    pairs = facts.select("a", "b", F.explode(F.try_element_at(names, "relation")).alias("ends"))

    def node(i: int) -> F.Column:
        end = F.substring("ends", i, 1)
        return F.concat(F.when(end == F.lower(end), F.col("a")).otherwise(F.col("b")), F.lit(":"), F.lower(end))

    return pairs.select(node(1).alias("src"), node(2).alias("dst"))


def ends(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, same): each end with the least name of those equal to it; (src, dst): which of these come first, closed."""
    names = facts.select(F.col("a").alias("x")).union(facts.select(F.col("b").alias("x"))).distinct()
    nodes = names.select(F.explode(F.array(F.concat("x", F.lit(":b")), F.concat("x", F.lit(":e")))).alias("node"))
    equal = _ends(facts, EQUAL)
    both = equal.unionByName(equal.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = closure(both).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
    same = materialize(nodes.join(least, "node", "left").select("node", F.least("node", "low").alias("same")), "ends")
    inside = names.select(F.concat("x", F.lit(":b")).alias("src"), F.concat("x", F.lit(":e")).alias("dst"))  # an interval begins before it ends
    first = _ends(facts, FIRST).unionByName(inside)
    for c in ("src", "dst"):
        first = first.join(same.withColumnRenamed("node", c), c).drop(c).withColumnRenamed("same", c)
    return same, materialize(closure(first), "first-ends")


def infer(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, relation): the relations that follow for pairs (a, b); a pair that doesn't follow to stand in one isn't listed.
    Told without contradiction, "before" reaches as far as the closure does."""
    same, first = ends(facts)
    out = pairs.select("a", "b").distinct()
    for name, x in (("ab", "a"), ("ae", "a"), ("bb", "b"), ("be", "b")):
        out = out.join(same.select(F.expr("substring(node, 1, length(node) - 2)").alias(x), F.substring("node", -1, 1).alias("__end"), F.col("same").alias(name)).where(F.col("__end") == name[1]).drop("__end"), x)

    def less(x: str, y: str) -> None:
        nonlocal out
        out = out.join(first.select(F.col("src").alias(x), F.col("dst").alias(y), F.lit(True).alias(f"{x}_{y}")), [x, y], "left")

    for x, y in (("ab", "bb"), ("bb", "ab"), ("ae", "be"), ("be", "ae"), ("ae", "bb"), ("be", "ab"), ("ab", "be"), ("bb", "ae")):
        less(x, y)
    t = {c: F.coalesce(F.col(c), F.lit(False)) for c in out.columns if "_" in c}
    tests = {
        "equals": (F.col("ab") == F.col("bb")) & (F.col("ae") == F.col("be")), "before": t["ae_bb"], "after": t["be_ab"], "meets": F.col("ae") == F.col("bb"), "met_by": F.col("ab") == F.col("be"),
        "starts": (F.col("ab") == F.col("bb")) & t["ae_be"], "started_by": (F.col("ab") == F.col("bb")) & t["be_ae"], "finishes": t["bb_ab"] & (F.col("ae") == F.col("be")), "finished_by": t["ab_bb"] & (F.col("ae") == F.col("be")),
        "overlaps": t["ab_bb"] & t["bb_ae"] & t["ae_be"], "overlapped_by": t["bb_ab"] & t["ab_be"] & t["be_ae"],
        "during": (t["bb_ab"] | (F.col("ab") == F.col("bb"))) & (t["ae_be"] | (F.col("ae") == F.col("be"))),
    }
    held = F.explode(F.filter(F.array(*(F.when(tests[r], F.lit(r)) for r in RELATIONS)), lambda r: r.isNotNull())).alias("relation")
    return out.select("a", "b", held)
