"""Language identification: averaged embeddings of hashed byte n-grams under a linear softmax.

Trained by stochastic gradient descent in numpy on stretches of a bounded sample of documents, of which the driver gets the
n-grams' numbers only. The softmax is calibrated by a temperature on documents of the sample that training doesn't see;
there, too, the score is chosen below which a prediction isn't accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import materialize, slices, unwrapped, utf8, wrapped
from lorekeep.llm.hashing import mix

BUCKETS = 1 << 16
OWN = ["held_out", "lang_pred", "score", "accepted"]
_FOLD = np.full(256, 32, np.uint64)  # letters fold, bytes of other scripts stay, the rest is space
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of the byte 3-grams and 4-grams that start at each byte (-1: white space inside)."""
    x = _FOLD[data]
    space = x == 32
    found = []
    for n in (3, 4):
        if len(x) < n:
            continue
        size = len(x) - n + 1
        total, inside = np.zeros(size, np.uint64), np.zeros(size, bool)
        for k in range(n):
            total = total * np.uint64(257) + x[k : k + size]
            if 0 < k < n - 1:
                inside |= space[k : k + size]
        bucket = (mix(total + np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int32)
        bucket[inside] = -1
        found.append(bucket)
    return found


def grams(text: bytes) -> np.ndarray:
    """The buckets of all n-grams of a text."""
    parts = [p[p >= 0] for p in subwords(np.frombuffer(b" " + text + b" ", np.uint8))]
    return np.concatenate(parts).astype(np.uint16) if parts else np.zeros(0, np.uint16)


def stretches(text: bytes, n: int, size: int) -> list[bytes]:
    """n stretches of so many bytes, spread evenly over the text; a text that isn't longer than they are is one."""
    if len(text) <= n * size:
        return [text]
    return [text[at : at + size] for at in np.linspace(0, len(text) - size, n).astype(int).tolist()]


def has_letter(text: bytes | None) -> bool:
    return bool(text) and bool(_ASCII_LETTER.search(text) or (not text.isascii() and any(c.isalpha() for c in text.decode())))


@dataclass
class Model:
    """``table`` is the product of embeddings and output weights, so that a text's logits are the mean of its n-grams' rows."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, max(1, len(text)), 1 << 16):  # whole texts, in blocks that overlap by an n-gram
            for bucket in subwords(np.frombuffer(b" " + text[at : at + (1 << 16) + 3] + b" ", np.uint8)):
                seen = np.bincount(bucket[bucket >= 0], minlength=1)
                at_ = np.flatnonzero(seen)
                total += seen[at_] @ self.table[at_]
                n += int(seen.sum())
        return total / max(n, 1) + self.bias

    def score(self, text: bytes) -> tuple[str, float]:
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Sample:
    """The n-grams of a stretch, its language, and whether its document calibrates."""

    grams: np.ndarray
    lang: str
    held: bool


def train(samples: list[Sample], dim: int = 16, steps: int = 10_000, epochs: int = 3, rate: float = 0.5, seed: int = 11) -> Model | None:
    """The model; None without samples. Every sample is seen ``epochs`` times, and more often if that makes less than ``steps``;
    languages are drawn alike."""
    samples = [s for s in samples if len(s.grams)]
    if not samples:
        return None
    langs = sorted({s.lang for s in samples})
    rng = np.random.default_rng(seed)
    shape = [(*np.unique(s.grams, return_counts=True), langs.index(s.lang), s.held) for s in samples]
    fit, held = [s for s in shape if not s[3]] or shape, [s for s in shape if s[3]] or shape
    embed, out, bias = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)), np.zeros((dim, len(langs))), np.zeros(len(langs))
    steps = max(steps, epochs * len(fit))
    of_lang = [x for x in ([i for i, s in enumerate(fit) if s[2] == y] for y in range(len(langs))) if x]
    for done, (y_, i_) in enumerate(zip(rng.integers(0, len(of_lang), steps).tolist(), rng.integers(0, 1 << 40, steps).tolist(), strict=True)):
        bucket, n, y, _ = fit[of_lang[y_][i_ % len(of_lang[y_])]]
        share = n / n.sum()
        mean = share @ embed[bucket]
        slope = softmax(mean @ out + bias)
        slope[y] -= 1
        step = rate * (1 - done / steps)
        back = out @ slope
        out -= step * np.outer(mean, slope)
        bias -= 0.1 * step * slope
        embed[bucket] -= step * np.minimum(share * 50, 1)[:, None] * back
    model = Model(langs, embed @ out, bias)
    raw = np.array([(n / n.sum()) @ model.table[b] + bias for b, n, _, _ in held])
    truth = np.array([y for _, _, y, _ in held])

    def loss(t: float) -> float:
        log = np.log(softmax(raw / t) + 1e-12)  # the truth counts 0.98, so that separable samples don't make the softmax certain
        return -float((0.98 * log[np.arange(len(truth)), truth] + 0.02 * log.mean(axis=1)).mean())

    model.temperature = min(np.geomspace(0.02, 20, 60), key=loss)
    p = softmax(raw / model.temperature)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum(p.argmax(axis=1)[order] == truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= 0.98)
    model.accept = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """Fixed fold: CRC-32 of the id as text, modulo 5, is 0. No id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def first_of(rows: DataFrame, n: int, *group: str, by: str = "doc_id") -> DataFrame:
    """The first n rows of each group, by a hash of a column."""
    order = Window.partitionBy(*group).orderBy(F.xxhash64(by), by)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def fit(docs: DataFrame, per_lang: int = 600, n_stretches: int = 4, size: int = 800) -> Model | None:
    """Trains outside the held-out fold: on up to per_lang rows of each language, chosen by a hash of doc_id, and of each on
    n_stretches of ``size`` bytes from all over its text. So many n-grams (two bytes each) reach the driver."""
    open_ = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    salted = open_.select("doc_id", "lang", F.pmod(F.hash("doc_id"), F.lit(16)).alias("salt"))
    chosen = materialize(first_of(first_of(salted, per_lang, "lang", "salt"), per_lang, "lang").select("doc_id", "lang").distinct(), "language-sample")
    rows = open_.select("text", "doc_id", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).where("text IS NOT NULL")
    rows = rows.select("text", "lang", F.xxhash64("doc_id").alias("h"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text, lang, h in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if has_letter(text):
                    found += [(lang, h, grams(piece).tobytes()) for piece in stretches(text, n_stretches, size)]
            kinds = [pa.string(), pa.int64(), pa.binary()]
            cols = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds]
            yield pa.record_batch(cols, ["lang", "h", "grams"])

    # repeated doc_ids may give more rows than were chosen
    seen = first_of(rows.mapInArrow(make, "lang string, h long, grams binary"), per_lang * n_stretches, "lang", by="grams").collect()
    seen = sorted((r.h, r.lang, bytes(r.grams)) for r in seen)
    return train([Sample(np.frombuffer(g, np.uint16), lang, h % 5 == 0) for h, lang, g in seen])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per input row: its columns, then held_out, lang_pred, score, accepted.

    lang_pred is 'und' with score 0 where the text is null or has no letter, and everywhere without a model. ``accepted`` is
    false where the calibrated score is below the model's bound. Only the text decides. Repeated rows come out each; input
    columns with the names of these are replaced.
    """
    rows = wrapped(docs, "text", OWN, held_out(F.col("doc_id")).alias("held_out"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score = [], []
            for text in utf8(batch.column(1)):
                best = model.score(text) if model and has_letter(text) else ("und", 0.0)
                lang.append(best[0])
                score.append(best[1])
            accepted = [x != "und" and s >= model.accept for x, s in zip(lang, score, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["__row", "text", *OWN])

    kind = rows.schema["__row"].dataType.simpleString()
    done = rows.mapInArrow(make, f"__row {kind}, text string, held_out boolean, lang_pred string, score double, accepted boolean")
    return unwrapped(done, docs, "text", OWN)
