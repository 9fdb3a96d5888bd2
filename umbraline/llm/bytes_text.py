"""Words and shingles of Arrow string batches by whole-array operations, on UTF-8 bytes.

Separators are blank and the bytes 9 to 13, all ASCII, so splitting bytes is splitting code points. Hashes have 64 bits:
a word's is a polynomial over a random byte table, odd base, modulo 2^64, then mixed. Work arrays cover at most
PIECE bytes at a time, cut at separators, so that a long text costs 16 bytes a word and no more.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_RANDOM = np.random.default_rng(20240229)
_TABLE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _TABLE[_LOWER]  # the table seen through A-Z lower-casing
SEPARATES = np.zeros(256, bool)
SEPARATES[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the rows' words). Words end with their row."""
    table = _LOWERED if lower else _TABLE
    hashes, starts, at = [], [], 0
    cuts = np.zeros(len(data) + 1, bool)
    cuts[ends] = True
    while at < len(data):
        stop = min(at + PIECE, len(data))
        if stop < len(data):  # cut where no word is cut: at a separator or a row's start; a huge word is taken whole
            inner = np.flatnonzero(SEPARATES[data[at:stop]] | cuts[at:stop])
            if len(inner) and inner[-1] > 0:
                stop = at + int(inner[-1])
            else:
                while stop < len(data) and not (SEPARATES[data[stop]] or cuts[stop]):
                    stop += 1
        part = data[at:stop]
        inside = ~SEPARATES[part]
        fresh = cuts[at:stop]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:] | fresh[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(finish) + 1
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[:len(part)], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = stop
    every = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(every, ends)


_TURNS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; those that start in the last k - 1 words of a row reach into the next row."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hashes[:n] * _TURNS[0]
    for j in range(1, k):
        out = out + (word_hashes[j:n + j] * _TURNS[j] ^ (word_hashes[j:n + j] >> np.uint64(29)))
    return mix(out)
