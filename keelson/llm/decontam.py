"""Benchmark decontamination with one FM-index per training shard.

Benchmark items become windows of consecutive words.  Every task builds, for
each shard of its documents, an FM-index over the words (suffix order, the
Burrows-Wheeler column in a wavelet matrix, sampled suffix positions), searches
all windows backwards through the ranks, locates their occurrences and merges
them into removal spans.  The alphabet is the benchmark's own vocabulary; any
other word, and every document end, is a terminator that no window crosses.

The benchmark travels in blocks of bounded size (``block_words`` words, one
broadcast each); a larger benchmark takes more blocks, each one more pass over
the shards' documents.  Documents longer than a shard are cut into pieces that
overlap by one word less than a window, so no occurrence is lost.

Contract for odd input: null or empty texts (and texts without words) have no
words, no hits and stay; an item without words has no windows; an item with a
null id counts for hits but is not listed; repeated items and rows count once
per id.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, map_batches, share, stored

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE = 8
_WORD_AT = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")   # the words of common.byte_words, with their places


# ---------------------------------------------------------------- phrases

class Phrases:
    """Windows of benchmark items as rows of vocabulary ids, and the items behind each window."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in byte_words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + window]), set()).add(item)
        keys = sorted(owners)
        self.owners = [sorted((x for x in owners[k] if x is not None), key=str) for k in keys]
        self.by_length = {}
        for n in sorted({len(k) for k in keys}):
            at = [i for i, k in enumerate(keys) if len(k) == n]
            self.by_length[n] = (np.array(at, dtype=np.int64), np.array([keys[i] for i in at], dtype=np.int64))


# ---------------------------------------------------------------- index

def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of ``text``; 0 is a terminator, and equal suffixes up to one stay in text order.

    Prefix doubling: the first sort covers as many symbols as fit beside the
    position in 63 bits, later rounds sort only what is still tied.
    """
    n = len(text)
    place = max(1, int(n).bit_length())
    width = max(1, (63 - place) // bits)
    key = np.zeros(n, dtype=np.int64)
    open_ = np.ones(n, dtype=bool)              # no terminator so far
    padded = np.concatenate([text, np.zeros(width, dtype=np.int64)])
    for j in range(width):
        symbol = np.where(open_, padded[j:j + n], 0)
        open_ &= symbol > 0
        key = (key << bits) | symbol
    packed = (key << place) | np.arange(n)
    packed.sort()
    order = packed & ((1 << place) - 1)
    key = packed >> place
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    rank = np.empty(n, dtype=np.int64)          # of a suffix: start of its group in the order
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    settled = ~open_[order]                     # ended within the key: text order is final
    group = np.where(settled, np.arange(n), group)
    rank[order] = group
    tied = np.flatnonzero(~settled & ~(first & np.append(first[1:], True)))
    while len(tied):
        at = order[tied]
        head = group[tied]
        # a tied suffix has no terminator within `width`, so at + width is inside the text
        packed = ((head << place) | rank[at + width])
        move = np.argsort(packed, kind="stable")
        at, packed = at[move], packed[move]
        order[tied] = at
        first = np.empty(len(tied), dtype=bool)
        first[0] = True
        np.not_equal(packed[1:], packed[:-1], out=first[1:])
        group[tied] = np.maximum.accumulate(np.where(first, tied, 0))
        rank[at] = group[tied]
        tied = tied[~(first & np.append(first[1:], True))]
        width *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol at any place, one bit vector with running counts a level."""

    def __init__(self, column: np.ndarray, bits: int):
        self.bits = bits
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = ((column >> level) & 1).astype(bool)
            ones = np.zeros(len(column) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(column) - int(ones[-1]))
            column = np.concatenate([column[~bit], column[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``place`` (element by element)."""
        low, high = np.zeros_like(place), place
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = ((symbol >> level) & 1).astype(bool)
            ones = self.ones[i]
            low = np.where(bit, self.zeros[i] + ones[low], low - ones[low])
            high = np.where(bit, self.zeros[i] + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Backward search and locating over a word text whose terminators are 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.append(text, 0).astype(np.int64)
        bits = max(1, int(symbols).bit_length())
        order = suffix_order(text, bits)
        self.column = text[order - 1]           # order 0 wraps to the final terminator
        self.wavelet = WaveletMatrix(self.column, bits)
        counts = np.bincount(text, minlength=symbols + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        # sampled: every `sample`-th place and every place after a terminator, where a walk must stop
        keep = (order % sample == 0) | (self.column == 0)
        self.sampled = keep
        self.slot = np.cumsum(keep) - 1
        self.places = order[keep]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase row, low, high) of the phrases that occur, by backward search."""
        alive = np.arange(len(phrases))
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.column), dtype=np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, j]
            base = self.before[symbol]
            low = base + self.wavelet.rank(symbol, low)
            high = base + self.wavelet.rank(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of index rows, walking back to the nearest sampled one."""
        place = np.empty(len(rows), dtype=np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            hit = self.sampled[rows]
            place[left[hit]] = self.places[self.slot[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            symbol = self.column[rows]
            rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return place


def occurrences(text: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window number, first word, length) of every occurrence in a word text (0: not in the vocabulary)."""
    inside = text > 0
    # runs of foreign words shrink to one terminator; `kept` maps back
    keep = inside | np.append(True, inside[:-1])
    kept = np.flatnonzero(keep)
    found = []
    if inside.any():
        index = FMIndex(text[kept], len(phrases.vocab))
        for n, (numbers, rows) in phrases.by_length.items():
            which, low, high = index.search(rows)
            if len(which):
                size = high - low
                row = np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                found.append((np.repeat(numbers[which], size), kept[index.locate(row)], np.full(len(row), n)))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_hits(texts: list, phrases: Phrases, shard_words: int = SHARD_WORDS) -> list[tuple]:
    """(number of words, hit spans of words, item ids) of every text."""
    word_count = [0] * len(texts)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    shard, owner, filled = [], [], 0

    def flush() -> None:
        nonlocal shard, owner, filled
        if not shard:
            return
        starts = np.cumsum([0] + [len(s) + 1 for s in shard])[:-1]
        text = np.concatenate([np.append(s, 0) for s in shard])
        number, first, length = occurrences(text, phrases)
        piece = np.searchsorted(starts, first, side="right") - 1
        order = np.lexsort((first, piece))
        for k in order:
            doc, offset = owner[piece[k]]
            items[doc].update(phrases.owners[number[k]])
            s = int(first[k] - starts[piece[k]]) + offset
            e = s + int(length[k])
            own = spans[doc]
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        shard, owner, filled = [], [], 0

    lookup = phrases.vocab.get
    for doc, text in enumerate(texts):
        words = byte_words(text)
        word_count[doc] = len(words)
        ids = np.fromiter(map(lookup, words, repeat(0)), dtype=np.int64, count=len(words))
        step = shard_words - phrases.window + 1
        for offset in range(0, max(1, len(ids) - phrases.window + 1), step):
            piece = ids[offset:offset + shard_words]
            if len(piece):
                shard.append(piece)
                owner.append((doc, offset))
                filled += len(piece)
            if filled >= shard_words:
                flush()
    flush()
    return list(zip(word_count, spans, (sorted(x, key=str) for x in items), strict=True))


# ---------------------------------------------------------------- Spark

def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int,
                  block_words: int) -> Iterator[Phrases]:
    """The benchmark in blocks of about ``block_words`` words; equal ids share a block."""
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[text_col].alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_words * 6)))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        yield Phrases([(r["item"], r["text"]) for r in rows], window)


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       block_words: int = 2_000_000, keep_text: bool = False) -> DataFrame:
    """(id, n_words, spans: array<struct<start,end>> of hit words, items: array of item ids as strings) per row.

    ``keep_text`` adds the text.  No shuffle: each block of the benchmark is one narrow pass that
    merges its spans and items into those of the blocks before it.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                     F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"),
                     F.expr("cast(array() as array<string>)").alias("items"))
    for k, phrases in enumerate(phrase_blocks(benchmark, item_col, item_text_col, window, block_words)):
        if k:
            rows = stored(rows, "decontam-block")            # one Python pass at a time holds a block
        rows = map_batches(rows, _search_block(share(df.sparkSession, phrases)), rows.schema)   # bounded by block_words
    return rows.select(F.col("id").alias(id_col), *([F.col("text").alias(text_col)] if keep_text else []),
                       "n_words", "spans", "items")


def _search_block(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared()
        for b in batches:
            spans, items = b.column(3).to_pylist(), b.column(4).to_pylist()
            found = find_hits(b.column(1).to_pylist(), phrases)
            for i, (_, own, names) in enumerate(found):
                if own:
                    earlier = [[x["start"], x["end"]] for x in spans[i]]
                    spans[i] = [{"start": s, "end": e} for s, e in merged(earlier + own)]
                    items[i] = sorted({*items[i], *map(str, names)})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([n for n, _, _ in found], pa.int64()),
                 pa.array(spans, b.schema.field(3).type), pa.array(items, b.schema.field(4).type)], schema=b.schema)
    return scan


def merged(spans: list) -> list:
    """Overlapping or touching spans joined, in order."""
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_spans(text: str, spans: list) -> str:
    """The text without the given word spans (whole words, their separators up to the next word included)."""
    places = [m.span() for m in _WORD_AT.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:places[s][0]])
        at = places[e][0] if e < len(places) else len(text)
    return "".join([*out, text[at:]])


def remove_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", length_col: str | None = None, window: int = WINDOW,
                         block_words: int = 2_000_000) -> DataFrame:
    """``df`` with removal spans cut out of ``text_col``; rows of which no word is left (but had some) go.

    A text without hits stays as it is.  ``length_col``, if given, follows a cut text.  All blocks of a
    large benchmark search the texts as they came; the last one cuts the merged spans of all.
    """
    names = df.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col else None
    spare = "__spans"
    while spare in {n.lower() for n in names}:
        spare += "_"
    kept = df.schema
    rows = df.withColumn(spare, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_words)
    phrases = next(blocks)
    for later in blocks:
        rows = stored(map_batches(rows, _mark_block(share(df.sparkSession, phrases), at), rows.schema), "decontam-block")
        phrases = later
    return map_batches(rows, _cut_block(share(df.sparkSession, phrases), at, length_at), kept)


def _with_earlier(b: pa.RecordBatch, at: int, phrases: Phrases) -> list[list]:
    """Spans of every text, merged with those of earlier blocks (the last column)."""
    found = find_hits(b.column(at).to_pylist(), phrases)
    return [merged([[x["start"], x["end"]] for x in earlier] + own)
            for earlier, (_, own, _) in zip(b.columns[-1].to_pylist(), found, strict=True)]


def _mark_block(shared, at: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared()
        for b in batches:
            spans = [[{"start": s, "end": e} for s, e in own] for own in _with_earlier(b, at, phrases)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, b.columns[-1].type)], schema=b.schema)
    return mark


def _cut_block(shared, at: int, length_at: int | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared()
        for b in batches:
            spans = _with_earlier(b, at, phrases)
            b = b.select(range(b.num_columns - 1))
            hit = [i for i, own in enumerate(spans) if own]
            if hit:
                columns = list(b.columns)
                texts = columns[at].to_pylist()
                for i in hit:
                    texts[i] = remove_spans(texts[i], spans[i])
                columns[at] = pa.array(texts, b.schema.field(at).type)
                if length_at is not None:
                    sizes = columns[length_at].to_pylist()
                    for i in hit:
                        sizes[i] = len(texts[i])
                    columns[length_at] = pa.array(sizes, b.schema.field(length_at).type)
                keep = np.ones(len(texts), dtype=bool)
                keep[[i for i in hit if not byte_words(texts[i])]] = False
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(keep))
            yield b
    return cut
