"""Homomorphic multiset hash of a document's paragraphs.

A paragraph (a non-empty line; long lines end at sentence marks too) hashes to
a wide vector; a document's fingerprint is the lane-wise sum of its paragraphs'
vectors, so it does not depend on their order, and paragraphs can be added or
taken away by adding or subtracting their vectors.  Lanes:

* ``EQUAL_LANES`` uniform lanes modulo 2**64, for equality of multisets;
* one count lane modulo 2**64;
* ``SKETCH_LANES`` lanes of +1 / -1 modulo 2**16: the squared distance of two
  such sums, divided by their number, estimates the squared distance of the two
  multisets, which gives a likeness from 0 to 1.

A fingerprint is the hex text of its lanes.  Contract for odd input: a null or
empty text has no paragraphs and the zero fingerprint; two zero fingerprints
are alike (1.0); repeated paragraphs count as often as they occur.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

EQUAL_LANES = 8
SKETCH_LANES = 128
LONG_LINE = 80            # characters; longer lines are cut after . ! ? and a space
_SENTENCE_END = re.compile(r"(?<=[.!?]) ")
_HASH_BYTES = 64


def paragraphs(text: str | None) -> list[str]:
    if not text:
        return []
    out = []
    for line in text.split("\n"):
        if len(line) > LONG_LINE:
            out += [p for p in _SENTENCE_END.split(line) if p]
        elif line:
            out.append(line)
    return out


def _lanes(pars: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, EQUAL_LANES) uint64 and (n, SKETCH_LANES) +-1 vectors of paragraphs."""
    need = EQUAL_LANES * 8 + SKETCH_LANES // 8
    digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=_HASH_BYTES).digest()
                       + hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=need - _HASH_BYTES,
                                         person=b"sketch").digest() for p in pars)
    raw = np.frombuffer(digests, dtype=np.uint8).reshape(len(pars), need)
    uniform = np.ascontiguousarray(raw[:, :_HASH_BYTES]).view(np.uint64)
    signs = np.unpackbits(raw[:, _HASH_BYTES:], axis=1).astype(np.int16) * 2 - 1
    return uniform, signs


class Fingerprints:
    """Fingerprints of many texts: rows of lanes."""

    def __init__(self, equal: np.ndarray, count: np.ndarray, sketch: np.ndarray):
        self.equal, self.count, self.sketch = equal, count, sketch

    @classmethod
    def of(cls, texts: list) -> Fingerprints:
        own = [paragraphs(t) for t in texts]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        equal = np.zeros((len(own), EQUAL_LANES), dtype=np.uint64)
        sketch = np.zeros((len(own), SKETCH_LANES), dtype=np.int16)
        some = np.flatnonzero(sizes)
        if len(some):
            uniform, signs = _lanes([p for x in own for p in x])
            first = (np.cumsum(sizes) - sizes)[some]
            equal[some] = np.add.reduceat(uniform, first, axis=0)            # wraps modulo 2**64
            sketch[some] = np.add.reduceat(signs, first, axis=0, dtype=np.int16)
        return cls(equal, sizes.astype(np.uint64), sketch)

    def __add__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.equal + other.equal, self.count + other.count, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.equal - other.equal, self.count - other.count, self.sketch - other.sketch)

    def packed(self) -> list[bytes]:
        """The lanes of each fingerprint, big-endian."""
        rows = np.concatenate([self.equal.astype(">u8").view(np.uint8).reshape(len(self.equal), -1),
                               self.count.astype(">u8").view(np.uint8).reshape(-1, 8),
                               self.sketch.astype(">i2").view(np.uint8).reshape(len(self.sketch), -1)], axis=1)
        return [r.tobytes() for r in rows]

    def hex(self) -> list[str]:
        return [r.hex() for r in self.packed()]

    @classmethod
    def from_hex(cls, texts: list[str]) -> Fingerprints:
        cut = EQUAL_LANES * 8
        rows = np.frombuffer(bytes.fromhex("".join(texts)), dtype=np.uint8).reshape(len(texts), -1)
        view = lambda x, kind: np.ascontiguousarray(x).view(kind)            # noqa: E731
        return cls(view(rows[:, :cut], ">u8").astype(np.uint64), view(rows[:, cut:cut + 8], ">u8").astype(np.uint64)[:, 0],
                   view(rows[:, cut + 8:], ">i2").astype(np.int16))

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """1 for equal multisets; else (both - distance) / (both + distance), estimated, below 1."""
        same = (self.equal == other.equal).all(axis=1) & (self.count == other.count)
        apart = (self.sketch - other.sketch).astype(np.float64)
        distance = np.maximum((apart ** 2).mean(axis=1), 1.0)
        both = self.count.astype(np.float64) + other.count.astype(np.float64)
        near = np.clip((both - distance) / np.maximum(both + distance, 1.0), 0.0, 1.0)
        return np.where(same, 1.0, near)
