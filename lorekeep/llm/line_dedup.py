"""Exact line deduplication over a corpus, with two Bloom filters in front of the shuffle.

Pass 1 turns every line into a key and every task's keys into sparse bit positions of a *once* filter (seen in a document)
and a *twice* filter (seen in a second one). Segments of the filters are merged on the executors: a bit that two tasks both
hold in *once* goes to *twice*. Only the *twice* filter, whose size is the parameter ``filter_bits``, is sent to all tasks.
Pass 2 looks every key up in it; only keys that are found shuffle. They are confirmed exactly by 128-bit digest, and the
smallest document that holds one keeps its lines. A filter that is too small for a corpus costs shuffle, never results.
Texts don't shuffle either, but for those that lose lines: a filter of their ids tells them from the others.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import held, materialize, slices, utf8, without

SPACE = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 1 << 20
LAST_ID = (1 << 63) - 1


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it has fewer than min_chars code points."""
    keys: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars
        keys.append(key if long else None)
    return keys


def positions(digests: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each 64-bit hash and its two bit positions there (rows of the second array)."""
    segment = (digests % np.uint64(segments)).astype(np.int32)
    first = (digests >> np.uint64(24)) & np.uint64(SEGMENT_BITS - 1)
    second = (digests >> np.uint64(44)) & np.uint64(SEGMENT_BITS - 1)
    return segment, np.stack([first, second]).astype(np.uint32)


def _filter_rows(hashes: list[np.ndarray], segments: int) -> pa.RecordBatch:
    """One row per segment: the sparse bits of hashes seen once at least, and of those seen twice in this task."""
    found, counts = np.unique(np.concatenate(hashes), return_counts=True)
    segment, bits = positions(found, segments)
    order = np.argsort(segment, kind="stable")
    segment, bits, twice = segment[order], bits[:, order], counts[order] > 1
    bounds = np.searchsorted(segment, np.arange(segments + 1))
    rows = [(s, bits[:, a:b].tobytes(), bits[:, a:b][:, twice[a:b]].tobytes()) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "once", "twice"])


def bloom(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], list[np.ndarray]], segments: int, repeated: bool = True) -> list[tuple[int, bytes]]:
    """The compressed segments of the filter of hashes that two rows or more hold, or any row; hashes_of gives each row's, distinct."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        held = 0
        for batch in slices(batches):
            for found in hashes_of(batch):
                hashes.append(found)
                held += len(found)
                if held >= 1 << 20:
                    yield _filter_rows(hashes, segments)
                    hashes, held = [], 0
        if held:
            yield _filter_rows(hashes, segments)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for s, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = once.setdefault(s, np.zeros(SEGMENT_BITS, bool))
                again = twice.setdefault(s, np.zeros(SEGMENT_BITS, bool))
                bits = np.frombuffer(one, np.uint32)
                again[bits[seen[bits]]] = True
                again[np.frombuffer(two, np.uint32)] = True
                seen[bits] = True
        found = twice if repeated else once
        packed = [zlib.compress(np.packbits(b).tobytes(), 1) for b in found.values()]
        if packed:
            yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array(packed, pa.binary())], ["segment", "bits"])

    parts = rows.mapInArrow(scan, "segment int, once binary, twice binary")
    merged = parts.repartition(segments, "segment").mapInArrow(merge, "segment int, bits binary")
    return [(r.segment, bytes(r.bits)) for r in merged.collect()]  # at most segments * SEGMENT_BITS / 8 bytes


class Suspects:
    """Looks hashes up in the broadcast filter; unpacked once in each Python worker, for the tasks of a stage."""

    def __init__(self, sent: Broadcast, segments: int):
        self.sent, self.segments, self.name = sent, segments, uuid.uuid4().hex

    def _filter(self) -> np.ndarray:
        whole = np.zeros(self.segments * SEGMENT_BITS // 8, np.uint8)
        for s, packed in self.sent.value:
            at = s * SEGMENT_BITS // 8
            whole[at : at + SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
        return whole

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        whole = held(self.name, self._filter)
        segment, bits = positions(hashes, self.segments)
        at = bits.astype(np.int64) + segment.astype(np.int64) * SEGMENT_BITS
        return ((whole[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def segments_for(n: int, most: int = 1 << 30) -> int:
    """Segments of a filter with 16 bits for each of n hashes, but ``most`` bits at most."""
    return min(max(1, 16 * n // SEGMENT_BITS + 1), most // SEGMENT_BITS)


def dedup_lines(docs: DataFrame, min_chars: int = 10, filter_bits: int | None = None) -> DataFrame:
    """Documents with repeated lines cut: the input's columns, then ``text``, ``n_lines`` (before), ``n_dropped``.

    A line whose key (white space stripped, A-Z lower-cased) has min_chars code points at least and occurs in two documents
    or more stays only in the smallest doc_id (a whole number) that holds it. A null or empty text is one empty line and
    comes out empty. Rows of one doc_id are one document. Rows without doc_id are one document that sorts last. Input columns
    named n_lines or n_dropped are replaced. An empty table gives an empty table. The filter has 16 bits a line, 2**30 at
    most, or filter_bits; its size never changes the result.
    """
    spark = docs.sparkSession
    whole = F.coalesce("text", F.lit(""))
    n_lines = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    segments = max(1, filter_bits // SEGMENT_BITS) if filter_bits else segments_for(docs.agg(F.sum(n_lines)).first()[0] or 0)

    def hashes_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        keys = ({k for k in line_keys(t or b"", min_chars) if k} for t in utf8(batch.column(0)))
        return [np.array([xxhash.xxh3_64_intdigest(k) for k in found], np.uint64) for found in keys]

    suspect = Suspects(spark.sparkContext.broadcast(bloom(docs.select("text"), hashes_of, segments)), segments)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys, owners, hashes = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), [], [], []
            for i, text in zip(ids, utf8(batch.column(1)), strict=True):
                for key in {k for k in line_keys(text or b"", min_chars) if k}:
                    keys.append(key)
                    owners.append(i)
                    hashes.append(xxhash.xxh3_64_intdigest(key))
            found = np.flatnonzero(suspect(np.array(hashes, np.uint64))).tolist() if hashes else []
            yield pa.record_batch([pa.array([owners[j][0] for j in found], pa.int64()), pa.array([owners[j][1] for j in found], pa.string()), pa.array([xxhash.xxh3_128_digest(keys[j]) for j in found], pa.binary())], ["owner", "own", "key"])

    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("owner")
    # rows without doc_id share an owner, but each text has its own keys to drop
    own = F.when(F.col("doc_id").cast("long").isNull(), F.md5(F.coalesce("text", F.lit("")))).otherwise("").alias("own")
    suspects = materialize(docs.select(owner, "text", own).mapInArrow(probe, "owner long, own string, key binary"), "line-suspects")
    first = suspects.groupBy("key").agg(F.min("owner").alias("first"), F.max("owner").alias("last")).where("first < last").select("key", "first")
    first = materialize(first, "line-keys")  # a plain join of two shuffles follows, so that Spark can split a very common line
    drops = suspects.join(first, "key").where("owner > first").groupBy("owner", "own").agg(F.collect_set("key").alias("__drop"))
    drops = materialize(drops, "line-drops")
    hurt = _holders(drops.select(F.xxhash64("owner", "own").alias("h")), drops.count())
    keep = without(docs, ["text", "n_lines", "n_dropped"])
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    rows = docs.select(row.alias("__row"), "text", owner, own).withColumn("__hurt", hurt(F.xxhash64("owner", "own")))
    same = rows.where("NOT __hurt").select("__row", whole.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    joined = rows.where("__hurt").join(drops, ["owner", "own"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, before, dropped = [], [], []
            for text, drop in zip(utf8(batch.column("text")), batch.column("__drop").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if drop:
                    gone = set(drop)
                    kept = [x for x, k in zip(lines, line_keys(text or b"", min_chars), strict=True) if not k or xxhash.xxh3_128_digest(k) not in gone]
                texts.append(b"\n".join(kept))
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            out = [batch.column("__row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.record_batch(out, ["__row", "text", "n_lines", "n_dropped"])

    row_type = rows.schema["__row"].dataType.simpleString()
    done = joined.select("__row", "text", "__drop").mapInArrow(cut, f"__row {row_type}, text string, n_lines long, n_dropped long")
    return same.unionByName(done).select(*[F.col(f"__row.`{c}`") for c in keep], "text", "n_lines", "n_dropped")


def _holders(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test whether a hash may be among the n given: never false for one that is."""
    segments = segments_for(n)

    def each(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.unique(batch.column(0).to_numpy().view(np.uint64))]

    among = Suspects(hashes.sparkSession.sparkContext.broadcast(bloom(hashes, each, segments, repeated=False)), segments)

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        return pd.Series(among(column.to_numpy().view(np.uint64)))

    return test
