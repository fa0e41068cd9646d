"""Packing of token streams into windows whose mixture of sources follows target proportions.

Every source is a queue of tokens. A window is a round of deficit round-robin: each queue earns its share of the window, is
served whole tokens and keeps the rest as a deficit for the next round; an empty queue's share goes to the others. Served
this way, token p of a queue of weight g has the finish time (p + 1/2) / g, and its place in the merged order is the number
of tokens of all queues that finish before. That number is a closed form of p, the weights and the queues' lengths, so each
task knows the deficits at any window without hearing of other tasks: they carry over windows and partitions exactly.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import held, materialize, slices, utf8
from lorekeep.llm.hashing import hashed_words

_TAIL = b"!#$%&()*+,-./:;=?@[]^_`{|}~\""


def _stem(word: bytes) -> tuple[bytes, bytes]:
    """A word's letters in lower case and the punctuation behind, where the tokenizer folds case and cuts between them.

    That is so behind an ASCII letter and a Latin one of two bytes; a word that may hold a special token stays whole.
    """
    if b"<|" in word:
        return word, b""
    stem = word.rstrip(_TAIL)
    last = stem[-1:]
    if last.isalpha() or stem[-2:-1] == b"\xc3" and last not in b"\x97\xb7":
        return stem.lower(), word[len(stem) :]
    return word.lower(), b""


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordTable:
    """Ids of words in arrays of a fixed size, by two 64-bit hashes: a word lies in one of four slots behind its first hash.

    A word that finds none of its slots free, or no room for its ids, isn't remembered.
    """

    def __init__(self, kind: np.dtype, slots: int, ids: int):
        self.slots = 1 << max(2, slots - 1).bit_length()
        self.hashes, self.starts = np.zeros((2, self.slots), np.uint64), np.zeros(self.slots, np.uint32)
        self.lengths, self.flat, self.used = np.full(self.slots, -1, np.int32), np.zeros(ids, kind), 0

    def _slots(self, hashes: np.ndarray, step: int) -> np.ndarray:
        return ((hashes + np.uint64(step)) & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each word's ids; length -1 where it isn't known."""
        starts, lengths = np.zeros(hashes.shape[1], np.int64), np.full(hashes.shape[1], -1, np.int64)
        for step in range(4):
            at = self._slots(hashes[0], step)
            hit = (self.hashes[0, at] == hashes[0]) & (self.hashes[1, at] == hashes[1]) & (self.lengths[at] >= 0)
            starts[hit], lengths[hit] = self.starts[at[hit]], self.lengths[at[hit]]
        return starts, lengths

    def add(self, hashes: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Takes in distinct words, whose ids stand in flat one after another."""
        ends = np.cumsum(lengths)
        n = int(np.searchsorted(ends, len(self.flat) - self.used, side="right"))
        if not n:
            return
        starts = self.used + ends - lengths
        self.flat[self.used : self.used + ends[n - 1]] = flat[: ends[n - 1]]
        self.used += int(ends[n - 1])
        open_ = np.arange(n)
        for step in range(4):
            at = self._slots(hashes[0, open_], step)
            free = np.flatnonzero(self.lengths[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            word = open_[free[first]]
            self.hashes[:, slot], self.starts[slot], self.lengths[slot] = hashes[:, word], starts[word], lengths[word]
            open_ = np.delete(open_, free[first])


class WordEncoder:
    """Ids of texts whose tokenizer folds case and never joins across ASCII white space: words are encoded once.

    Words are found by hash in numpy, so that Python touches only those that aren't known yet; of them only stems that
    aren't known go to the tokenizer. The words and stems seen first are remembered, about ``words`` (some 32 bytes each)
    and ``stems`` (some 250 bytes each) of them.
    """

    def __init__(self, path: str, words: int = 1 << 19, stems: int = 80_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.table, self.memory, self.stems = WordTable(self.kind, words, 4 * words), stems, {b"": b""}

    def _encode(self, stems: list[bytes]) -> dict[bytes, bytes]:
        fresh = {}
        for at in range(0, len(stems), 4096):
            part = stems[at : at + 4096]
            for stem, found in zip(part, self.tokenizer.encode_batch_fast([s.decode() for s in part], add_special_tokens=False), strict=True):
                fresh[stem] = array(self.kind.char, found.ids).tobytes()
        return fresh

    def _new(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that the table doesn't know."""
        stems, pairs = self.stems, [_stem(w) for w in words]
        fresh = self._encode(list({x for pair in pairs for x in pair if x not in stems}))
        if len(stems) < self.memory:
            stems.update(fresh)
        return [(fresh[a] if a in fresh else stems[a]) + (fresh[b] if b in fresh else stems[b]) for a, b in pairs]

    def __call__(self, texts: list[bytes], end: bytes) -> list[bytes]:
        whole = b" ".join(texts)
        starts, ends, hashes = hashed_words(whole, lower=False, tables=2)
        _, first, back = np.unique(hashes[0], return_index=True, return_inverse=True)
        if (hashes[1] != hashes[1][first][back]).any():  # two words with one hash: never seen, but then words by themselves
            return [b"".join(self._new(t.split())) + end for t in texts]
        begin, length = self.table.find(hashes[:, first])
        missing = length < 0
        known = self.table.flat[_ranges(begin[~missing], length[~missing])]
        at = first[missing]
        ids = self._new([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        length[missing] = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        flat = np.concatenate([known, np.frombuffer(b"".join(ids), self.kind)])  # of the batch's words: the known, then the new
        begin[~missing] = np.cumsum(length[~missing]) - length[~missing]
        begin[missing] = len(known) + np.cumsum(length[missing]) - length[missing]
        if len(at):
            self.table.add(hashes[:, at], length[missing], flat[len(known) :])
        begin, length = begin[back], length[back]
        every = flat[_ranges(begin, length)]
        size = np.cumsum([len(t) + 1 for t in texts])
        bounds = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, np.concatenate([[0], size]))].tolist()
        return [every[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, queue: F.Column) -> DataFrame:
    """doc_id, queue, part, before, n, ids: each document's ids with end_id behind; ``before`` counts its queue's tokens
    that the same part (a task's slice of the input) holds before it. A table, so that parts stay as they are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, served = TaskContext.get().partitionId(), {}
        for batch in slices(batches, 1000, 2 << 20):
            encode = held(f"encoder {tokenizer}", lambda: WordEncoder(tokenizer))
            end = np.array([end_id], encode.kind).tobytes()
            queues = batch.column(1).to_pylist()
            ids = encode([t or b"" for t in utf8(batch.column(2))], end)
            sizes = [len(x) // encode.kind.itemsize for x in ids]
            before = []
            for q, n in zip(queues, sizes, strict=True):
                before.append(served.get(q, 0))
                served[q] = before[-1] + n
            cols = [batch.column(0), batch.column(1), pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.record_batch(cols, ["doc_id", "queue", "part", "before", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text")
    return materialize(rows.mapInArrow(make, "doc_id long, queue string, part long, before long, n long, ids binary"), "tokens")


class Mixture:
    """The merged order of all queues: lengths and integer weights, by queue number."""

    def __init__(self, lengths: list[int], targets: list[float]):
        total = sum(lengths)
        unit = 1 << max(8, min(30, 61 - (2 * total + 1).bit_length()))
        self.lengths, share = lengths, sum(targets)
        self.weights = [max(1, round(unit * t / share)) for t in targets]

        # queues of one length and weight are served alike: one entry for each such class, with its queues in order
        order = np.lexsort([lengths, self.weights])
        kinds = np.stack([np.array(self.weights, np.int64)[order], np.array(lengths, np.int64)[order]])
        first = np.flatnonzero(np.append(True, (kinds[:, 1:] != kinds[:, :-1]).any(axis=0)))
        self.classes = [(int(w), int(n), members) for (w, n), members in zip(kinds[:, first].T, np.split(order, first[1:]), strict=True)]
        self.of = np.array(self.weights, np.int64)

    def place(self, queue: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The place in the merged order of token p of each queue; equal finish times go by queue number."""
        own = self.of[queue]
        double, place = 2 * own, p.copy()
        for weight, length, members in self.classes:
            ahead = (2 * p + 1) * weight + own
            if len(members) == 1:
                j = members[0]
                place += np.where(j == queue, 0, np.minimum((ahead - (j > queue)) // double, length))
                continue
            low = np.searchsorted(members, queue)  # so many of the class have a smaller number
            inside = members[np.minimum(low, len(members) - 1)] == queue
            place += low * np.minimum(ahead // double, length) + (len(members) - low - inside) * np.minimum((ahead - 1) // double, length)
        return place

    def slices(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, window: int, most: int = 1 << 20) -> Iterator[slice]:
        """The rows in groups that make about ``most`` pieces or less, or of one row."""
        if n.sum() <= most:
            yield slice(0, len(n))
            return
        pieces = np.minimum(n, self.place(queue, start + n - 1) // window - self.place(queue, start) // window + 1)
        at, held = 0, 0
        for i, k in enumerate(pieces.tolist()):
            if held and held + k > most:
                yield slice(at, i)
                at, held = i, 0
            held += k
        if held:
            yield slice(at, len(pieces))

    def cuts(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the token ranges [start, start + n): row, first token (in its range), length, window number."""
        first, last = self.place(queue, start) // window, self.place(queue, start + n - 1) // window
        bounds = last - first
        thin = bounds >= n  # more borders than tokens: each token by itself
        bounds = np.where(thin, 0, bounds)
        row = np.repeat(np.arange(len(n)), bounds)
        target = (np.arange(len(row)) - np.repeat(np.cumsum(bounds) - bounds, bounds) + first[row] + 1) * window
        low, high = start[row].copy(), (start + n - 1)[row]
        while (low < high).any():  # the first token at or behind the window's border
            mid = (low + high) // 2
            ahead = self.place(queue[row], mid) >= target
            low, high = np.where(ahead, low, mid + 1), np.where(ahead, mid, high)
        size = np.where(thin, n, 0)
        alone = np.repeat(np.arange(len(n)), size)
        token = np.arange(len(alone)) - np.repeat(np.cumsum(size) - size, size)
        home = self.place(queue[alone], start[alone] + token) // window
        border = np.append(False, home[1:] != home[:-1])[: len(home)] & (token > 0)
        alone, token = alone[border], token[border]
        rows, at = np.concatenate([np.arange(len(n)), row, alone]), np.concatenate([np.zeros(len(n), np.int64), low - start[row], token])
        order = np.lexsort([at, rows])
        rows, at = rows[order], at[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1])
        rows, at = rows[fresh], at[fresh]
        ends = np.append(at[1:], 0)
        ends[np.append(rows[1:] != rows[:-1], True)] = n
        return rows, at, ends - at, self.place(queue[rows], start[rows] + at) // window


def numbered(queues: DataFrame) -> DataFrame:
    """queue, n and number: the queues' places by name, from the counts of sorted parts, as a table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), places], ["queue", "n", "part", "at"])

    held = materialize(queues.select("queue", "n").orderBy("queue").mapInArrow(count, "queue string, n long, part long, at long"), "queues")
    sizes = sorted((r.part, r.n) for r in held.groupBy("part").agg(F.count("*").alias("n")).collect())
    ahead, rows = 0, []
    for part, n in sizes:
        rows.append((part, ahead))
        ahead += n
    return held.join(F.broadcast(held.sparkSession.createDataFrame(rows, "part long, ahead long")), "part").select("queue", "n", (F.col("at") + F.col("ahead")).alias("number"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, source: str = "source", targets: dict[str, float] | None = None, with_ids: bool = True, max_broadcast: int = 100_000) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, and ids (little-endian, 32 bits).

    Every token of every document (its ids and end_id) lies in one piece. Windows are filled to the last but one; the last
    holds the rest. ``targets`` are weights by queue name, by default the queues' own shares of tokens, which all windows then
    show; queues without a target get the least one given. Every source is a queue, however many there are (null: '').
    Queues are held by number (a weight and a place in its class each); their names are joined. A null text has no ids but end_id; repeated rows are packed each; rows
    without doc_id are packed too; an empty table gives no piece. Other columns are ignored.
    """
    tokens = tokenize(docs, tokenizer, end_id, F.coalesce(F.col(source).cast("string"), F.lit("")))
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    queues = numbered(parts.groupBy("queue").agg(F.sum("n").alias("n")))
    aims = docs.sparkSession.createDataFrame([(q, float(t)) for q, t in (targets or {}).items()], "queue string, target double")
    held = queues.join(F.broadcast(aims), "queue", "left").select("number", "n", "target").toArrow().sort_by("number")  # two numbers a queue
    lengths = held["n"].to_pylist()
    least = min(targets.values()) if targets else 0.0
    share = [least if t is None else t for t in held["target"].to_pylist()] if targets else lengths
    mixture = docs.sparkSession.sparkContext.broadcast(Mixture(lengths or [1], share or [1.0]))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    few = len(lengths) <= max_broadcast
    queues = F.broadcast(queues) if few else queues
    base = base.join(queues.select("queue", "number"), "queue")
    base = F.broadcast(base) if few and base.count() <= max_broadcast else base  # queues times parts: not rows, but it grows
    placed = tokens.join(base, ["queue", "part"]).select("doc_id", "number", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs_, ids = batch.column(0), batch.column(4).to_pylist()
        queue = batch.column(1).to_numpy().astype(np.int64)
        start, n = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
        rows, at, length, sequence = mixture.value.cuts(queue, start, n, window)
        cut_ids, crc, held, own = [], [], -1, None
        for r, a, k in zip(rows.tolist(), at.tolist(), length.tolist(), strict=True):
            if r != held:
                held, own = r, np.frombuffer(ids[r], f"<u{len(ids[r]) // int(n[r])}").astype("<u4").tobytes()
            piece = own[4 * a : 4 * (a + k)]
            crc.append(zlib.crc32(piece))
            cut_ids.append(piece if with_ids else None)
        cols = [docs_.take(pa.array(rows)), pa.array(at), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[rows]), pa.array(sequence), pa.array(queue[rows]), pa.array(start[rows] + at), pa.array(cut_ids, pa.binary())]
        return pa.record_batch(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "queue_no", "p", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            queue, start, n = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            for part in mixture.value.slices(queue, start, n, window):
                yield cut(batch.slice(part.start, part.stop - part.start))

    pieces = placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, queue_no long, p long, ids binary")
    ahead = Window.partitionBy("sequence_id").orderBy("queue_no", "p").rowsBetween(Window.unboundedPreceding, -1)  # a window's pieces
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0))
    names = queues.select(F.col("number").alias("queue_no"), "queue")
    out = pieces.withColumn("offset", offset).join(F.broadcast(names) if few else names, "queue_no")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", *["ids"] * with_ids)


def sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (array), n_tokens: the pieces put together, padded to the window unless the length is a power of two."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = []
        for parts in batch.column("parts").to_pylist():
            row = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
            if len(row) & (len(row) - 1):
                row = np.append(row, np.full(window - len(row), pad_id, row.dtype))
            ids.append(row)
        return pa.record_batch([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int64())), batch.column("n_tokens")], ["sequence_id", "ids", "n_tokens"])

    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    return whole.mapInArrow(lambda batches: (make(b) for b in batches if b.num_rows), "sequence_id long, ids array<long>, n_tokens long")
