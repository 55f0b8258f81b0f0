"""MinHash signatures over word shingles, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingled(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles, row starts): runs of `words` words, or the whole sequence of fewer; none without words."""
    starts, index, vocabulary = common.flat_words(texts)
    if not len(index):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    token = common.hash_strings(vocabulary)[index]
    sizes = np.diff(starts)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - words + 1, 1))
    out_starts = np.concatenate(([0], np.cumsum(counts)))
    first = np.arange(out_starts[-1]) + np.repeat(starts[:-1] - out_starts[:-1], counts)
    length = np.repeat(np.minimum(sizes, words), counts)
    h = length.astype(np.uint64)
    whole = int(sizes.max()) >= words
    for k in range(words):
        at = np.minimum(first + k, len(token) - 1)
        step = common.mixed(h * _MULTIPLIER + token[at])
        h = step if whole and (length >= words).all() else np.where(k < length, step, h)
    return h, out_starts


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of n universal hash functions x -> (a x + b) mod 2^64, of which the top bits count."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def signatures(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Top 16 bits of the minimum of each hash function over each row's shingles: uint16[rows, n]; 65535 without any."""
    rows = len(starts) - 1
    out = np.full((rows, n), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(starts) > 0)
    if not len(full):
        return out
    a, b = permutations(n)
    at = starts[:-1][full]
    least = np.empty((n, len(full)), np.uint64)
    buffer = np.empty(len(h), np.uint64)
    for k in range(n):
        np.multiply(h, a[k], out=buffer)
        np.add(buffer, b[k], out=buffer)
        least[k] = np.minimum.reduceat(buffer, at)
    # the low bits of a minimum are as random as its hash; the top ones are small for long texts
    out[full] = (common.mixed(least) >> np.uint64(48)).astype(np.uint16).T
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of one row."""
    s = np.sort(h)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
