"""Word shingles, MinHash signatures and the Bayesian pruning table of the n-gram Jaccard join."""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash

from .common import byte_words

SHINGLE = 5
BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
STEP = 20                      # MinHash values compared between two looks at the posterior
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(5)
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_COLUMNS = 1024                # shingles hashed at a time, to stay in cache


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams.

    Fewer words than n, but some, are one shingle; a text without words, but not empty, is one
    shingle as a whole; a null or empty text has none.
    """
    words = byte_words(text)
    if not words:
        return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=1)] if text else [],
                        dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    s = np.full(len(h) - width + 1, np.uint64(width))
    for j in range(width):
        s = (s + h[j:len(h) - width + 1 + j]) * _MULTIPLIER
    return np.unique(mixed(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, 16 bits of each."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), _COLUMNS):
        part = (x[None, i:i + _COLUMNS] ^ _XOR[:, None]) * _ODD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (((low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit bucket numbers; a bucket belongs to one band."""
    s = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.ones((len(s), 1), dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = mixed(key * _MULTIPLIER + s[:, :, j])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After STEP, 2 STEP, ... values: the fewest matches that keep a pair.

    With a uniform prior on the similarity s and m of n values equal, the posterior is Beta(m + 1,
    n - m + 1), and P(s >= t) is the probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def surviving_pairs(a: np.ndarray, b: np.ndarray | None, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signature rows that the posterior keeps; within ``a`` (i < j) if ``b`` is None."""
    other = a if b is None else b
    matches = np.zeros((len(a), len(other)), dtype=np.int16)
    for c in range(STEP):
        matches += a[:, None, c] == other[None, :, c]
    alive = matches >= least[0]
    if b is None:
        alive &= np.triu(np.ones(alive.shape, dtype=bool), 1)
    i, j = np.nonzero(alive)
    count = matches[i, j].astype(np.int32)
    for k, need in enumerate(least[1:], start=1):
        if not len(i):
            break
        cut = slice(k * STEP, (k + 1) * STEP)
        for s in range(0, len(i), 1 << 18):                   # blocks bound the memory
            e = slice(s, s + (1 << 18))
            count[e] += (a[i[e], cut] == other[j[e], cut]).sum(axis=1)
        keep = count >= need
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def first_band_is(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Whether ``band`` is the first band in which the rows of each pair agree."""
    out = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), 1 << 16):
        e = slice(s, s + (1 << 16))
        same = (a[i[e]] == b[j[e]]).reshape(-1, BANDS, BAND_ROWS).all(axis=2)
        out[e] = same.any(axis=1) & (same.argmax(axis=1) == band)
    return out


def exact_overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, by bit rows over the shingles that two sets share."""
    used = np.unique(np.concatenate([i, j]))
    at = np.zeros(len(sets), dtype=np.int64)
    at[used] = np.arange(len(used))
    flat = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    some, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1                          # a shingle of one set is in no intersection
    shared = count[where] > 1
    bit, owner = number[where[shared]], owner[shared]
    words = max(1, -(-int((count > 1).sum()) // 64))
    rows = np.zeros((len(used), words), dtype=np.uint64)
    np.bitwise_or.at(rows, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    out = np.empty(len(i), dtype=np.int64)
    block = max(1, (4 << 20) // words)
    for s in range(0, len(i), block):
        e = slice(s, s + block)
        out[e] = np.bitwise_count(rows[at[i[e]]] & rows[at[j[e]]]).sum(axis=1)
    return out
