"""Near-duplicate groups by min-max hashing, confirmed on whole shingle sets.

Each permutation gives two signature values, its minimum and its maximum over the shingle set; both match between two sets
with the probability of their Jaccard similarity, so half the hash evaluations of plain MinHash serve as many values. Bands
of values are bucket keys. Texts with equal words are one class from the start. A bucket's pairs aren't listed. First every
member is compared with a pivot, the member that has most bucket mates; what links falls into one component. For what is
left, shingles that few of the texts left hold tell pairs apart. Pairs that share some come from an index of them. Pairs that
share none are bounded by the counts of other shingles alone, so that whole kinds of members are ruled out at once. So every
pair that shares a bucket is in one component, ruled out by an exact bound, or compared on its full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import map_batches, materialize, utf8
from lorekeep.llm.hashing import mix, shingle_set, word_hashes

CHUNK = 1 << 15
SPLIT = 256  # a bucket's members meet what is known of the bucket in groups of about so many, so that none is one task's
RARE = 64  # a shingle is rare if so many of the texts left hold it at most; any number gives the same result


def bands_for(threshold: float, miss: float = 1e-7) -> tuple[int, int]:
    """Rows and bands: a band matches at the threshold with about 0.3, and all bands miss with ``miss`` at most."""
    rows = max(1, round(math.log(0.3) / math.log(threshold)))
    return rows, math.ceil(math.log(miss) / math.log(1 - threshold**rows))


class MinMax:
    """Signatures of shingle sets: for permutation k the minimum and the maximum of k-th odd multiples modulo 2**64."""

    def __init__(self, rows: int, bands: int, seed: int = 7):
        self.rows, self.bands = rows, bands
        rng = np.random.default_rng(seed)
        self.multipliers = rng.integers(1, 1 << 62, (rows * bands + 1) // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def buckets(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of band keys for each set; an empty set's row means nothing."""
        out = np.zeros((len(sets), self.bands), np.uint64)
        at = 0
        while at < len(sets):  # chunks whose arrays stay in the cache
            end, total = at, 0
            while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
                total += len(sets[end])
                end += 1
            full = [i for i in range(at, end) if len(sets[i])]
            if full:
                out[full] = self._chunk([sets[i] for i in full])
            at = end
        return out

    def _chunk(self, sets: list[np.ndarray]) -> np.ndarray:
        values = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        n = self.rows * self.bands
        signature = np.empty((2 * len(self.multipliers), len(sets)), np.uint64)
        for k, m in enumerate(self.multipliers):
            x = values * m
            signature[k] = np.minimum.reduceat(x, starts)
            signature[len(self.multipliers) + k] = np.maximum.reduceat(x, starts)
        keys = np.zeros((self.bands, len(sets)), np.uint64)
        for r in range(self.rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:n].reshape(self.bands, self.rows, len(sets))[:, r])
        return mix(keys + np.arange(self.bands, dtype=np.uint64)[:, None]).T


def _text_key(text: bytes | None) -> bytes:
    words = (text or b"").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signatures(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    minmax = MinMax(rows, bands)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        sets = [shingle_set(word_hashes(t or b""), shingle) for t in texts]
        keys = np.ascontiguousarray(minmax.buckets(sets))
        offsets = np.arange(0, keys.size + 1, bands, dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), _signed(keys.reshape(-1)))
        cols = [batch.column(0), pa.array([_text_key(t) for t in texts], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists]
        return pa.record_batch(cols, ["doc_id", "text_key", "n_shingles", "buckets"])

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, text_key binary, n_shingles long, buckets array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(word_hashes(t or b""), shingle).tobytes() for t in utf8(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return map_batches(docs, make, "id long, shingles binary")


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, both shingle sets) those with 100 * intersection >= percent * union."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
            x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        out = pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"])
        return out.filter(pa.array(keep))

    return map_batches(pairs, make, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge (a, b).

    Each round every component looks at its smallest neighbour and hooks to it if that is smaller; chains of hooks are
    followed by doubling; the edges that still join two components go to the next round.
    """
    labels = None
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("to")), "hooks")
        while True:  # follow hooks until all point to a root
            up = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
            hooks = materialize(hooks.join(up, "to", "left").select("id", F.coalesce("next", "to").alias("new"), F.col("to").alias("old")), "hooks")
            moved = hooks.where("new <> old").limit(1).count()
            hooks = hooks.select("id", F.col("new").alias("to"))
            if not moved:
                break
        if labels is None:
            labels = hooks.select("id", F.col("to").alias("component"))
        else:
            step = hooks.select(F.col("id").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        one, two = (hooks.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        edges = edges.join(one, "a").join(two, "b").where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()
        edges = materialize(edges, "edges")
        if not edges.limit(1).count():
            return materialize(labels, "components")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct runs of ``shingle`` words
    (all its words, if fewer). Documents are linked if 100 * |intersection| >= percent * |union|; component_id is the
    smallest doc_id reachable over links, and that document is kept. A null text or one without words has the empty set, is
    linked with nothing and kept. Rows of one doc_id are judged each by its own text; equal rows share the result.
    Rows without doc_id are alone in their components (null) and kept. Other columns are ignored.
    """
    rows, bands = bands_for(percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(_signatures(docs, shingle, rows, bands), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "buckets")).alias("rep"))
    classes = materialize(classes.select("text_key", "rep.*"), "classes")
    spread = classes.select(F.explode("buckets").alias("bucket"), "id", "n")
    # a table, so that the join is one of two shuffles and Spark can split a hot bucket
    shared = materialize(spread.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1"), "buckets")
    labels = link(docs, materialize(spread.join(shared, "bucket"), "members"), shingle, percent)
    of_class = classes.select("text_key", "id").join(labels, "id", "left").select("text_key", F.coalesce("component", "id").alias("component"))
    found = signed.select(F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("text_key")).alias("text_key"), "doc_id", "n_shingles")
    found = found.join(of_class, "text_key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def rare_shingles(sets: DataFrame, most: int) -> DataFrame:
    """(id, h, df): the shingles that at most ``most`` sets of the table hold."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), [len(s) for s in every])
        return pa.record_batch([pa.array(ids), pa.array(np.concatenate(every))], ["id", "h"])

    rows = map_batches(sets.select("id", "shingles"), spread, "id long, h long")
    rare = rows.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    return rows.join(rare, "h")


def of_bucket(live: DataFrame, known: DataFrame) -> DataFrame:
    """Members joined with the one row of ``known`` (bucket, mates, …) of their bucket: the rows of large buckets are copied
    to as many groups as their members are dealt to."""
    groups = F.ceil(F.col("mates") / SPLIT)
    dealt = live.withColumn("group", F.pmod(F.xxhash64("id"), groups))
    copies = known.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1))).drop("mates")
    return dealt.join(copies, ["bucket", "group"]).drop("group")


def link(docs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Components (id, component) of the ids in ``members`` (bucket, id, n, mates: the bucket's size)."""
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = materialize(_sets(docs.join(wanted, "doc_id", "left_semi"), shingle), "shingles")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("two"))

    def confirmed(near: DataFrame, other: str) -> DataFrame:
        pairs = near.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct()
        return materialize(_confirm(pairs.join(one, "a").join(two, "b"), percent), "links")

    def may_link(n: str, rare: str, n2: str, rare2: str) -> F.Column:
        """Whether two sets of n shingles, of which they share none of the rare ones, can reach the threshold."""
        most = F.least(F.col(n) - F.col(rare), F.col(n2) - F.col(rare2))
        return 100 * most >= percent * (F.col(n) + F.col(n2) - most)

    def alike() -> F.Column:
        """Whether two sets' sizes alone allow the threshold."""
        return 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")

    def by_pivots(live: DataFrame) -> DataFrame:
        best = live.groupBy("bucket").agg(F.max("mates").alias("mates"), F.max(F.struct("degree", (-F.col("id")).alias("low"), "id", "n", "component")).alias("p"))
        pivots = materialize(best.select("bucket", "mates", F.col("p.id").alias("pivot"), F.col("p.n").alias("n2"), F.col("p.component").alias("component2")), "pivots")
        return confirmed(of_bucket(live, pivots).where((F.col("component") != F.col("component2")) & alike()), "pivot")

    degree = members.groupBy("id").agg(F.sum("mates").alias("degree"))
    live = materialize(members.join(degree, "id").select("bucket", "mates", "id", "n", "degree", F.col("id").alias("component")), "live")
    links = by_pivots(live)
    labels = components(links)

    def left(live: DataFrame) -> DataFrame:
        """The members of buckets that still hold several components, with their components."""
        held = live.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = held.groupBy("bucket").agg(F.max("mates").alias("mates"), F.min("component").alias("low"), F.max("component").alias("high"))
        return of_bucket(held, mixed.where("low < high").select("bucket", "mates"))

    live = materialize(left(live), "live")
    links = links.unionByName(by_pivots(live))
    labels = components(links)
    live = materialize(left(live), "live")
    ids = live.groupBy("id").agg(F.min("n").alias("n"), F.min("component").alias("component"))
    rare = materialize(rare_shingles(sets.join(ids.select("id"), "id", "left_semi"), RARE), "rare")
    of_id = rare.groupBy("id").agg(F.count("*").alias("rare"))
    ids = materialize(ids.join(of_id, "id", "left").withColumn("rare", F.coalesce("rare", F.lit(0))), "left-ids")

    # pairs with a rare shingle in common: their overlap is that of rare shingles and at most the lesser count of others
    mates = ids.select(*[F.col(c).alias(f"{c}2") for c in ids.columns])
    shared = rare.where("df > 1").select("h", "id").join(ids.select("id", "n", "component"), "id")
    other = shared.select("h", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "component")])
    both = shared.join(other, "h").where((F.col("id") < F.col("id2")) & (F.col("component") != F.col("component2")) & alike())
    both = both.groupBy("id", "id2").agg(F.count("*").alias("common")).join(ids.drop("component"), "id").join(mates.drop("component2"), "id2")
    most = F.col("common") + F.least(F.col("n") - F.col("rare"), F.col("n2") - F.col("rare2"))
    near = both.where(100 * most >= percent * (F.col("n") + F.col("n2") - most)).select("id", "id2")

    # pairs without: the lesser count of others alone bounds the overlap, so that pairs are ruled out by kinds of members
    live = materialize(live.select("bucket", "id", "component").join(ids.select("id", "n", "rare"), "id").where(100 * (F.col("n") - F.col("rare")) >= percent * F.col("n")), "live")
    kinds = materialize(live.groupBy("bucket", "n", "rare").agg(F.min("component").alias("low"), F.max("component").alias("high")), "kinds")
    other = kinds.select("bucket", *[F.col(c).alias(f"{c}2") for c in kinds.columns[1:]])
    several = ~((F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2")))
    ordered = F.struct("n", "rare") <= F.struct(F.col("n2").alias("n"), F.col("rare2").alias("rare"))
    near_kinds = kinds.join(other, "bucket").where(ordered & several & may_link("n", "rare", "n2", "rare2")).select("bucket", "n", "rare", "n2", "rare2")
    mates = live.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "rare", "component")])
    bare = live.join(near_kinds, ["bucket", "n", "rare"]).join(mates, ["bucket", "n2", "rare2"]).where("component <> component2 AND id <> id2").select("id", "id2")
    return components(links.unionByName(confirmed(near.unionByName(bare), "id2")))
