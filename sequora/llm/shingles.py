"""Sets of word shingles as sorted 64-bit hashes, computed over whole slices of texts with numpy.

Words are the runs of bytes other than the six ASCII white-space bytes, after A-Z are lower-cased. A word's hash is a
polynomial over random byte codes (mod 2**64, odd base), mixed with its length; a shingle's hash combines the hashes of
its words. Two different shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sequora.llm.arrow_text import slices

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_CODE[65:91] = _CODE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = _rng.integers(2**62, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) for i below n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text, and of the end; hashes of all words)."""
    n = len(data)
    inside = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = offsets[:-1][offsets[:-1] < n]
    before[starts] = False
    first = np.flatnonzero(inside & ~before)
    after = np.ones(n + 1, bool)
    after[:n] = ~inside
    after[starts] = True
    last = np.flatnonzero(inside & after[1:]) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * up[:n], out=sums[1:])
    words = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _MIX[8])
    return np.searchsorted(first, offsets), words


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Of each text, its distinct shingle hashes, sorted. Fewer words than ``width`` are one shingle, none are none."""
    at, words = word_hashes(offsets, data)
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full += words[k : len(words) - width + 1 + k] * _MIX[k]
    full = mixed(full)
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= width:
            yield np.unique(full[lo : hi - width + 1])
        elif hi > lo:
            yield mixed((words[lo:hi] * _MIX[: hi - lo]).sum(keepdims=True) + np.array([hi - lo], np.uint64) * _MIX[9])
        else:
            yield full[:0]


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, offsets, data in slices(column):
        yield from shingle_sets(offsets, data, width)


def set_hash(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set."""
    if not len(hashes):
        return 0
    total = (mixed(hashes + _MIX[10]) * _MIX[11]).sum(keepdims=True) + np.array([len(hashes)], np.uint64) * _MIX[12]
    return int(mixed(total).view(np.int64)[0])
