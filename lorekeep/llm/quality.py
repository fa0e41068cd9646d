"""Document quality by labelling its lines: a linear-chain conditional random field marks each as content or boilerplate.

The field is trained on the lines of a bounded sample of labelled documents: a logistic model of single lines first decides
which lines of the bad documents are boilerplate, then the field learns those sequences. Viterbi decoding labels the lines
of every document; the share of its words in content lines decides. Plain counts reject documents before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import slices, unwrapped, utf8, wrapped
from lorekeep.llm.hashing import mix, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": SYMBOLS, "shout": b"!", "pipe": b"|", "blank": SPACE}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def repeated_words(words: np.ndarray) -> np.ndarray:
    """Of word hashes: whether each word lies in a three-word window that the text holds twice or more."""
    covered = np.zeros(len(words), bool)
    if len(words) > 3:
        windows = mix(mix(words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:])
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[back] > 1
        for k in range(3):
            covered[k : k + len(again)] |= again
    return covered


@dataclass
class Lines:
    """Counts of a text and, for each of its lines, the number of words and the features."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    line_words: np.ndarray
    features: np.ndarray


def describe(text: bytes) -> Lines:
    data = np.frombuffer(text + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    blank = _TABLES["blank"][data]
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    line_words = per_line(begins)
    words = word_hashes(text, lower=False)
    covered = repeated_words(words)
    of_word = np.repeat(np.arange(len(starts)), line_words)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    seen: set[bytes] = set()
    again = np.zeros(len(starts), bool)
    for i, line in enumerate(text.split(b"\n")):
        again[i] = line in seen and line_words[i] > 0
        seen.add(line)
    size, n = np.maximum(ends - starts, 1), np.maximum(line_words, 1)
    upper, lower, digit, symbol, shout, pipe = (per_line(_TABLES[k][data]) for k in ("upper", "lower", "digit", "symbol", "shout", "pipe"))
    runs, looped = (np.bincount(of_word[x], minlength=len(starts)) for x in (same, covered))
    ratio = [symbol / size * 5, upper / np.maximum(upper + lower, 1), shout / n, pipe / n, runs / n, looped / n, digit / size]
    features = np.stack(
        [np.ones(len(starts)), *(np.minimum(x, 1) for x in ratio), symbol > 0.05 * size, upper > 0.6 * np.maximum(upper + lower, 1), shout > 0.3 * n, pipe > 0.2 * n, runs > 0.3 * n, looped > 0.5 * n, line_words == 0, line_words < 3, np.log1p(line_words) / 5, again], axis=1
    ).astype(np.float32)
    chars = int(((data & 0xC0) != 0x80).sum() - blank.sum())
    return Lines(int(line_words.sum()), chars, len(text) - len(text.translate(None, SYMBOLS)), int(again.sum()), int(covered.sum()), line_words, features)


@dataclass
class ChainField:
    """A two-state linear-chain field: weights of state 1 (content) over state 0, and transition scores."""

    weights: np.ndarray
    transitions: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the most probable state of each line."""
        unary = (features @ self.weights).tolist()
        (a00, a01), (a10, a11) = self.transitions.tolist()
        s0, s1, back = 0.0, unary[0], []
        for u in unary[1:]:
            from0, from1 = s0 + a00 < s1 + a10, s0 + a01 < s1 + a11
            back.append((from0, from1))
            s0, s1 = (s1 + a10 if from0 else s0 + a00), (s1 + a11 if from1 else s0 + a01) + u
        state, states = s1 >= s0, [s1 >= s0]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return np.array(states[::-1], bool)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed + x.T @ ((y - p) * weight) / weight.sum() - 1e-4 * w
        w += speed
    return w


def _groups(docs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of like length, padded: features, states, mask."""
    docs = sorted(docs, key=lambda d: len(d[0]))
    at = 0
    while at < len(docs):
        end = at + 1
        while end < len(docs) and len(docs[end][0]) <= 1.3 * len(docs[at][0]) + 2:
            end += 1
        part, longest = docs[at:end], len(docs[end - 1][0])
        x = np.zeros((len(part), longest, part[0][0].shape[1]), np.float32)
        y, mask = np.zeros((len(part), longest), np.int64), np.zeros((len(part), longest), bool)
        for i, (f, s) in enumerate(part):
            x[i, : len(f)], y[i, : len(f)], mask[i, : len(f)] = f, s, True
        yield x, y, mask
        at = end


def _gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, field: ChainField) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood: observed less expected counts, by the forward-backward algorithm."""
    n, t, _ = x.shape
    unary = np.stack([np.zeros((n, t)), x @ field.weights], axis=2)
    a = field.transitions
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    forward[:, 0] = unary[:, 0]
    for k in range(1, t):
        step = np.logaddexp(forward[:, k - 1, :1] + a[0], forward[:, k - 1, 1:] + a[1]) + unary[:, k]
        forward[:, k] = np.where(mask[:, k, None], step, forward[:, k - 1])
    for k in range(t - 2, -1, -1):
        ahead = unary[:, k + 1] + backward[:, k + 1]
        step = np.logaddexp(a[:, 0] + ahead[:, :1], a[:, 1] + ahead[:, 1:])
        backward[:, k] = np.where(mask[:, k + 1, None], step, 0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    p = np.exp(forward + backward - total[:, None, None])
    unit = ((y - p[:, :, 1]) * mask)[:, :, None] * x
    pair = np.zeros((2, 2))
    both = mask[:, 1:]
    for i in range(2):
        for j in range(2):
            expected = np.exp(forward[:, :-1, i] + a[i, j] + unary[:, 1:, j] + backward[:, 1:, j] - total[:, None])
            pair[i, j] = (((y[:, :-1] == i) & (y[:, 1:] == j)) * both).sum() - (expected * both).sum()
    return unit.sum(axis=(0, 1)), pair


def train(docs: list[tuple[np.ndarray, int]], rounds: int = 60) -> ChainField | None:
    """The field from (line features, quality 0 or 1); None if one of the qualities is missing."""
    docs = [d for d in docs if len(d[0])]
    if {q for _, q in docs} != {0, 1}:
        return None
    x = np.concatenate([f for f, _ in docs])
    y = np.concatenate([np.full(len(f), q) for f, q in docs])
    bad = (y == 0).mean()
    w = _logistic(x, y, np.where(y == 0, 0.5 / bad, 0.5 / (1 - bad)))
    labelled = [(f, np.ones(len(f), np.int64) if q else (f @ w > 0).astype(np.int64)) for f, q in docs]
    field, speed_w, speed_a = ChainField(w.copy(), np.zeros((2, 2))), np.zeros(len(w)), np.zeros((2, 2))
    groups = list(_groups(labelled))
    for _ in range(rounds):
        grad_w, grad_a = map(sum, zip(*(_gradient(*g, field) for g in groups), strict=True))
        speed_w = 0.8 * speed_w + grad_w / len(x) - 1e-3 * field.weights
        speed_a = 0.8 * speed_a + grad_a / len(x) - 1e-3 * field.transitions
        field = ChainField(field.weights + speed_w, field.transitions + speed_a)
    return field


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> ChainField | None:
    """Trains on at most ``sample`` labelled documents, chosen by a hash of doc_id; only their line features reach the driver."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [describe(t or b"").features.tobytes() for t in utf8(batch.column(0))]
            yield pa.record_batch([pa.array(found, pa.binary()), batch.column(1)], ["features", "quality"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("quality").cast("int").alias("quality"))
    width = describe(b"").features.shape[1]
    held = rows.mapInArrow(make, "features binary, quality int").limit(sample).collect()
    return train([(np.frombuffer(r.features, np.float32).reshape(-1, width), r.quality) for r in held])


def judge(docs: DataFrame, field: ChainField | None, min_share: float = 0.5) -> DataFrame:
    """One row per input row: its columns, then the counts, base_failed, kept and content_share.

    A null text has no words and fails. Without a field (no labels of both kinds) every line is content. Repeated rows are
    judged each; an empty table gives an empty one; input columns with the names of these are replaced.
    """
    rows = wrapped(docs, "text", OWN)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in utf8(batch.column(1)):
                d = describe(text or b"")
                failed = d.n_words < 50 or 100 * d.n_repeat_words > 50 * d.n_words
                content = field.decode(d.features) if field else np.ones(len(d.line_words), bool)
                share = float(d.line_words[content].sum() / d.n_words) if d.n_words else 0.0
                out.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, not failed and share >= min_share, share))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.record_batch([batch.column(0), batch.column(1), *cols], ["__row", "text", *OWN])

    kind = rows.schema["__row"].dataType.simpleString()
    schema = f"__row {kind}, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return unwrapped(rows.mapInArrow(make, schema), docs, "text", OWN)
