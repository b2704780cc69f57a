"""Byte-level BPE encoding by a pair occurrence index, and decoding.

A task splits its texts into pre-tokens and merges the distinct ones of a batch
together: an index maps every adjacent pair of symbols to all its positions,
the active ranks leave a heap in ascending order, each rank is applied at all
its positions from left to right, and the lists of the pairs that arise are
extended.  As merges never cross a pre-token, the result equals merging every
pre-token on its own.

The tokenizer file is read on the driver and broadcast (its size is checked
against ``MAX_TOKENIZER_BYTES``); nothing else is shared and nothing shuffles.

Contract for odd input: a null or empty text has no ids and decodes to the
empty text; a very long pre-token is one entry of the index like any other;
rows are independent.  Only the named columns are read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_batches, share

MAX_TOKENIZER_BYTES = 64 << 20
CACHED_PIECES = 300_000         # distinct pieces of text a task keeps between batches
BLOCK_LETTERS = 1 << 19         # letters of the texts that are cut into pieces together (a longer text is cut alone)
INDEX_LETTERS = 1 << 18         # letters of the words of one pair index (a longer word is one of its own)
WIDE = 24                       # positions of a rank from which numpy takes over
PAIR_BITS = 20                  # token ids are below 2 ** 20

# Fixed value: the public pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Coarser cuts that no pre-token crosses: a run without white space and the single space before it, or white space.
PIECE = " ?[^{0}]+|[{0}]+(?![^{0}])|[{0}]+".format(
    "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    letter = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class Tokenizer:
    """A byte-level BPE vocabulary in the form the encoder and decoder need."""

    def __init__(self, spec: dict):
        model, kind = spec["model"], (spec.get("pre_tokenizer") or {}).get("type")
        if model["type"] != "BPE" or kind != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") \
                or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        if max(vocab.values()) >= 1 << PAIR_BITS:
            raise ValueError("token ids do not fit a pair")
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]      # by rank
        self.rank_of: dict[int, int] = {}                    # pair of ids in one number -> rank
        for rank, (a, b, _) in enumerate(self.merges):
            self.rank_of.setdefault((a << PAIR_BITS) + b, rank)
        self._keys = np.array(sorted(self.rank_of), dtype=np.int64)
        self._ranks = np.array([self.rank_of[k] for k in self._keys.tolist()], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} \
            | {i: t.encode() for t, i in self.added.items()}

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair number, -1 where there is no merge."""
        at = np.minimum(np.searchsorted(self._keys, pairs), len(self._keys) - 1)
        return np.where(self._keys[at] == pairs, self._ranks[at], -1)

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
            raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


class PairIndex:
    """Symbols of many words in a row, and all positions of every pair that has a rank.

    Each word is followed by -1, over which no pair reaches.  ``few`` and ``many`` hold the
    positions of a rank, single ones and whole arrays; entries whose pair has gone since are
    told by the symbols when their rank's turn comes.
    """

    def __init__(self, words: list[str], tok: Tokenizer):
        pieces = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        letters = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        row = np.full(len(letters) + len(pieces), -1, dtype=np.int64)
        row[np.arange(len(letters)) + np.repeat(np.arange(len(pieces)), sizes)] = tok.byte_id[letters]
        n = len(row)
        self.tok = tok
        # one buffer each, seen by single steps as arrays of Python and by wide ones as numpy's
        self.symbol, self.after, self.before = (array("q", x.tobytes()) for x in (
            row, np.arange(1, n + 1), np.arange(-1, n - 1)))
        self.few: dict[int, list[int]] = {}
        self.many: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.arange(n - 1), row[:-1], row[1:])

    def _add(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Enter the pairs at ``at`` that have a rank."""
        ranks = self.tok.ranks_of((left << PAIR_BITS) + right)
        ranks[(left < 0) | (right < 0)] = -1
        some = np.flatnonzero(ranks >= 0)
        some = some[np.argsort(ranks[some], kind="stable")]
        ranks, at = ranks[some], at[some]
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, s, e in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=False):
            if rank in self.many:
                self.many[rank].append(at[s:e])
            else:
                self.many[rank] = [at[s:e]]
                if rank not in self.few:
                    heapq.heappush(self.active, rank)

    def merge_all(self) -> None:
        """Apply the active ranks in ascending order, each at all its positions from left to right."""
        while self.active:
            rank = heapq.heappop(self.active)
            single, arrays = self.few.pop(rank, []), self.many.pop(rank, [])
            if len(single) + sum(map(len, arrays)) < WIDE:
                self._merge_single(rank, sorted({*single, *(p for x in arrays for p in x.tolist())}))
            else:
                parts = [*arrays, np.array(single, dtype=np.int64)]
                self._merge_wide(rank, np.unique(np.concatenate(parts)))

    def _merge_single(self, rank: int, positions: list[int]) -> None:
        symbol, after, before, few, many = self.symbol, self.after, self.before, self.few, self.many
        rank_of, (left, right, both) = self.tok.rank_of.get, self.tok.merges[rank]
        for p in positions:
            q = after[p]
            if symbol[p] != left or symbol[q] != right:      # used up by an earlier merge
                continue
            symbol[p], symbol[q] = both, -2
            r = after[p] = after[q]
            before[r] = p
            o = before[p]
            for at, new in ((o, rank_of((symbol[o] << PAIR_BITS) + both) if o >= 0 else None),
                            (p, rank_of((both << PAIR_BITS) + symbol[r]))):
                if new is None:
                    continue
                if new in few:
                    few[new].append(at)
                else:
                    few[new] = [at]
                    if new not in many:
                        heapq.heappush(self.active, new)

    def _merge_wide(self, rank: int, p: np.ndarray) -> None:
        symbol, after, before = (np.frombuffer(x, dtype=np.int64) for x in (self.symbol, self.after, self.before))
        left, right, both = self.tok.merges[rank]
        q = after[p]
        live = (symbol[p] == left) & (symbol[q] == right)
        p, q = p[live], q[live]
        if left == right and len(p):                         # of overlapping pairs every second one stays
            number = np.arange(len(p))
            start = np.maximum.accumulate(np.where(np.append(True, p[1:] != q[:-1]), number, 0))
            keep = (number - start) % 2 == 0
            p, q = p[keep], q[keep]
        r = after[q]
        symbol[p], symbol[q] = both, -2
        after[p], before[r] = r, p
        o = before[p]
        whole = np.full(len(p), both)
        self._add(np.concatenate([o, p]), np.concatenate([np.where(o >= 0, symbol[o], -1), whole]),
                  np.concatenate([whole, symbol[r]]))

    def words(self) -> list[bytes]:
        """Ids of each word, as bytes of int32."""
        row = np.frombuffer(self.symbol, dtype=np.int64)
        flat = row[row >= 0].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(row >= 0)[row == -1]).tolist()
        return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def merge_words(words: list[str], tok: Tokenizer) -> list[bytes]:
    """Token ids of each word (bytes of int32), by one pair index over some ``INDEX_LETTERS`` at a time."""
    out: list[bytes] = []
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    start = 0
    while start < len(words):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + INDEX_LETTERS, side="right")))
        index = PairIndex(words[start:end], tok)
        index.merge_all()
        out += index.words()
        start = end
    return out


class Encoder:
    """Encodes batches of texts; keeps the ids (as bytes of int32) of pieces seen lately.

    A text is first cut before every single space that stands between other
    characters and around longer white space; no pre-token crosses these cuts, so
    only pieces not seen lately go through the pre-token pattern and the index.
    """

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.split = regex.compile(PRE_TOKEN).findall
        self.cut = re.compile(PIECE).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict = {}
        names = sorted(tok.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.first = tuple(names)

    def cuts(self, text: str | None) -> list:
        """Pieces of a text; an added token is a one-element tuple of its id."""
        if not text:
            return []
        if self.marks is None or not any(m in text for m in self.first):
            return self.cut(text)
        out: list = []
        for part in self.marks.split(text):
            out += [(self.tok.added[part],)] if part in self.tok.added else self.cut(part)
        return out

    def split_piece(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; letters, and letters before one mark, need no pattern."""
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            return [piece]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [piece[:-1], word[-1]]
        return self.split(piece)

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; the pieces of some ``BLOCK_LETTERS`` are at hand at a time."""
        out: list[np.ndarray] = []
        start = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= BLOCK_LETTERS or end == len(texts):
                out += self._encode_block(texts[start:end])
                start, size = end, 0
        return out

    def _encode_block(self, texts: list) -> list[np.ndarray]:
        rows = [self.cuts(t) for t in texts]
        used = set(chain.from_iterable(rows))
        if len(self.pieces) > CACHED_PIECES:                 # those of this batch, the frequent ones among them, stay
            self.pieces = {p: self.pieces[p] for p in used.intersection(self.pieces)}
        if len(self.words) > CACHED_PIECES:
            self.words = {}
        new = used.difference(self.pieces)
        split = {p: self.split_piece(p) for p in new if isinstance(p, str)}
        words = list(set(chain.from_iterable(split.values())).difference(self.words))
        self.words.update(zip(words, merge_words(words, self.tok), strict=True))
        ids = self.words.__getitem__
        for p in new:
            own = split.get(p)
            self.pieces[p] = array("i", p).tobytes() if own is None else ids(own[0]) if len(own) == 1 else b"".join(map(ids, own))
        known = self.pieces.__getitem__
        return [np.frombuffer(b"".join(map(known, r)), dtype=np.int32) for r in rows]


def list_array(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


class Decoder:
    """Texts of token ids: the bytes of all tokens, special ones too, read as UTF-8."""

    def __init__(self, tok: Tokenizer):
        pieces = [tok.token_bytes.get(i, b"") for i in range(max(tok.token_bytes) + 1)]
        self.size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        size = self.size[flat]
        first = np.cumsum(size) - size
        data = self.pool[np.repeat(self.start[flat] - first, size) + np.arange(size.sum())].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))].tolist()
        return pa.array([data[s:e].decode("utf-8", "replace") for s, e in zip(ends, ends[1:], strict=False)], pa.string())


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """(id, *keep, ids: array<int>), one row per input row.

    ``decoded`` adds the text that the ids decode to, by the same tasks (one Python worker a core).
    """
    kept = [id_col, *keep]
    narrow = df.select(*[df[c] for c in kept], df[text_col].alias("__text"))
    shared = share(df.sparkSession, Tokenizer.from_file(tokenizer_path))
    names = [*kept, "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared()
        encoder, decoder = Encoder(tok), Decoder(tok)
        for b in batches:
            ids = list_array(encoder.encode(b.column(b.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, *([decoder.decode(ids)] if decoded else [])], names=names)

    return map_batches(narrow, run, f"{_fields(df, kept)}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, decoded: string); null ids decode to the empty text."""
    kept = [id_col, *keep]
    narrow = df.select(*[df[c] for c in kept], df[ids_col].alias("__ids"))
    shared = share(df.sparkSession, Tokenizer.from_file(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], decoder.decode(b.column(b.num_columns - 1))],
                                             names=[*kept, "decoded"])

    return map_batches(narrow, run, f"{_fields(df, kept)}, decoded string")
