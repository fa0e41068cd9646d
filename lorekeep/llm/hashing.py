"""Vectorised hashing of words and word shingles: numpy over whole batches of UTF-8 text, no Python per word."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20260101)
_TABLES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C1B)  # odd, 3 modulo 8
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 18
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK, _BASE, np.uint64)]))
_INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK, _INVERSE, np.uint64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array: runs without ASCII white space."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _blocks(text: bytes) -> list[tuple[int, int]]:
    """Ranges of the text that end behind white space; a word longer than a block makes a long one."""
    found, at, blanks = [], 0, (b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r")
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        if end < len(text):
            cut = max(text.rfind(s, at, end) for s in blanks)
            if cut < at:
                cut = min((c for c in (text.find(s, end) for s in blanks) if c >= 0), default=len(text) - 1)
            end = cut + 1
        found.append((at, end))
        at = end
    return found


def hashed_words(text: bytes, lower: bool = True, tables: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (a row for each of independent tables) of the words: polynomials of random byte values modulo
    2**64, from prefix sums."""
    starts, ends, hashes = [], [], []
    for at, end in _blocks(text):
        data = np.frombuffer(text, np.uint8, end - at, at)
        powers, inverses = _POWERS, _INVERSES
        if len(data) > _BLOCK:
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE, np.uint64)]))
            inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INVERSE, np.uint64)]))
        first, last = _spans(data)
        rows = []
        for values in _TABLES[:tables]:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((values[_LOWER] if lower else values)[data] * powers[: len(data)], out=total[1:])
            rows.append(mix((total[last] - total[first]) * inverses[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        ends.append(last + at)
        hashes.append(np.stack(rows))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((tables, 0), np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes, axis=1)


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased or not."""
    return hashed_words(text, lower)[2][0]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``size`` words; fewer words are one run, none give an empty set."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(mix(total + np.uint64(min(size, len(words)))))
