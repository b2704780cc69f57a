"""N-gram Jaccard join with Bayesian candidate pruning.

1. Texts with equal shingle sets form a *class*; only its smallest id goes on.
2. Classes that agree in a band of their MinHash signature share a bucket.  Of
   buckets with the same members only the one of the lowest band stays.
3. Pairs of a bucket are compared STEP MinHash values at a time; a pair goes
   when the posterior probability of reaching the threshold falls below the
   tolerance.  A pair is decided in the first band it agrees in, so only there.
4. The exact Jaccard similarity of the shingle sets decides the rest.

Buckets above ``BLOCK`` members are dealt into blocks, and pairs of blocks are
tasks of their own, so no task holds a large group; pairs never become rows:
a block passes on, per class, how many documents it is linked with and a
spanning edge.  Links between different texts are all counted (copies weigh as
many as they are), and groups are the connected components of the links.

What can be lost, with the default threshold 0.8, tolerance 1e-6 and 32 bands of
5 values: a pair of similarity exactly 0.8 shares no bucket with probability
(1 - 0.8**5)**32 = 3e-6, and is pruned wrongly with probability below 1e-5.

Contract for odd input: null and empty texts have no shingles, no links and a
group of their own; fewer than five words are one shingle; a text without words
is one shingle is one shingle as a whole (so equal non-empty texts are always one class);
repeated rows are copies; rows of one id with different texts are compared as
different texts and fall in one group only through links; a row with a null id
takes no part (null class, no links).  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import map_batches, stored

THRESHOLD = 0.8
TOLERANCE = 1e-6
BLOCK = 1024                  # members of a bucket that one task holds twice, at most
BLOCK_SHINGLES = 2_000_000    # and their shingles, on average
BROADCAST_IDS = 1_000_000     # ids (8 bytes each) up to which the set pass filters by a broadcast


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a shingle set."""
    key = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(key[0]), int(key[1])


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, n, sig): a 128-bit key of the shingle set, its size and signature; nulls without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, size, sig = [], [], [], []
            for text in b.column(1).to_pylist():
                s = minhash.shingle_set(text)
                if not len(s):
                    k1.append(None), k2.append(None), size.append(0), sig.append(None)
                    continue
                key = _set_key(s)
                k1.append(key[0]), k2.append(key[1]), size.append(len(s))
                sig.append(minhash.signature(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(sig, pa.binary())], names=["id", "k1", "k2", "n", "sig"])

    narrow = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, "id bigint, k1 bigint, k2 bigint, n bigint, sig binary")


def classes_of(rows: DataFrame) -> DataFrame:
    """(h, rep, k1, k2, size, n, sig): one row per shingle set; ``rep`` is its smallest id, ``h`` its own number.

    Store the result before use: ``h`` is stable only then.
    """
    return rows.filter("k1 is not null and id is not null").groupBy("k1", "k2").agg(
        F.min(F.struct("id", "n", "sig")).alias("m"), F.count("*").alias("size")) \
        .select(F.monotonically_increasing_id().alias("h"), F.col("m.id").alias("rep"), "k1", "k2", "size",
                F.col("m.n").alias("n"), F.col("m.sig").alias("sig"))


def memberships(classes: DataFrame) -> DataFrame:
    """(bucket, band, blocks, h) of buckets with at least two members, without repeats of one member set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint16).reshape(-1, minhash.HASHES)
            keys = minhash.band_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(minhash.BANDS, dtype=np.int32), len(keys))),
                 pa.array(np.repeat(b.column(0).to_numpy(), minhash.BANDS)),
                 pa.array(np.repeat(b.column(1).to_numpy(), minhash.BANDS))], names=["bucket", "band", "h", "n"])

    rows = map_batches(classes.select("h", "n", "sig"), run, "bucket bigint, band int, h bigint, n bigint")
    # sums of two hashes tell member sets apart without gathering them (decimals: no overflow)
    total = [F.sum(F.xxhash64("h", F.lit(k)).cast("decimal(20,0)")).alias(f"members{k}") for k in (1, 2)]
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"),
                                         F.first("band").alias("band"), *total).filter("count > 1")
    kept = buckets.groupBy("count", "members1", "members2").agg(
        F.min(F.struct("band", "bucket", "shingles")).alias("m")) \
        .select("m.bucket", "count", F.col("m.shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return rows.select("bucket", "band", "h").join(kept, "bucket") \
        .select("bucket", "band", blocks.alias("blocks"), "h")


def dealt(members: DataFrame) -> DataFrame:
    """Each membership in every pair of blocks that its own block is part of: (bucket, band, x, y, mine, h)."""
    block = F.pmod(F.xxhash64("h", "bucket"), F.col("blocks")).cast("int")
    return members.withColumn("mine", block).select(
        "bucket", "band", "h", "mine",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", "band", "h", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal values in the first ``keys`` columns of sorted batches."""
    current, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            key = tuple(int(c[s]) for c in columns)
            if key != current and parts:
                yield current, parts
                parts = []
            current = key
            parts.append(b.slice(s, e - s))
    if parts:
        yield current, parts


def _signatures(parts: list[pa.RecordBatch], column: int) -> np.ndarray:
    blob = b"".join(x for p in parts for x in p.column(column).to_pylist())
    return np.frombuffer(blob, dtype=np.uint16).reshape(-1, minhash.HASHES)


def _kept_pairs(key: tuple, mine: np.ndarray, sig: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) of one block pair that survive the pruning and belong to this band."""
    _, band, x, y = key
    if x == y:
        i, j = minhash.surviving_pairs(sig, None, least)
    else:
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        if not len(left) or not len(right):
            return (np.empty(0, dtype=np.int64),) * 2
        i, j = minhash.surviving_pairs(sig[left], sig[right], least)
        i, j = left[i], right[j]
    first = minhash.first_band_is(sig, sig, i, j, band)
    return i[first], j[first]


_KEYS = ["bucket", "band", "x", "y"]


def _by_block_pair(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS)


def prune(members: DataFrame, classes: DataFrame, least: list[int]) -> DataFrame:
    """The rows of ``dealt`` that have a surviving pair in their block pair."""
    rows = _by_block_pair(dealt(members).join(classes.select("h", "sig"), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _groups(batches, 4):
            h = np.concatenate([p.column(4).to_numpy() for p in parts])
            mine = np.concatenate([p.column(5).to_numpy() for p in parts])
            i, j = _kept_pairs(key, mine, _signatures(parts, 6), least)
            some = np.unique(np.concatenate([i, j]))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), key[0])), *[pa.array(np.full(len(some), k, dtype=np.int32)) for k in key[1:]],
                     pa.array(h[some]), pa.array(mine[some])], names=[*_KEYS, "h", "mine"])

    return map_batches(rows.select(*_KEYS, "h", "mine", "sig"), run,
                       "bucket bigint, band int, x int, y int, h bigint, mine int")


def sets_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, shingles) of the wanted classes, from one more pass over the texts."""
    narrow = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)                    # else a shuffle join

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [minhash.shingle_set(t) for t in b.column(0).to_pylist()]
            keys = [_set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["k1", "k2", "shingles"])

    made = map_batches(narrow.join(ids, "id", "left_semi").select("text"), run, "k1 bigint, k2 bigint, shingles binary")
    # an id may have other texts, and the same text twice
    return made.join(wanted.select("h", "k1", "k2"), ["k1", "k2"]).select("h", "shingles").dropDuplicates(["h"])


def verify(kept: DataFrame, classes: DataFrame, sets: DataFrame, least: list[int], threshold: float) -> DataFrame:
    """(h, rep, linked, root): per block pair, documents linked to a class and the least id it is connected with."""
    full = classes.select("h", "rep", "size", "sig").join(sets, "h")
    rows = _by_block_pair(kept.join(full, "h")).select(*_KEYS, "h", "mine", "sig", "size", "shingles", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _groups(batches, 4):
            h, mine, size, rep = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (4, 5, 7, 9))
            i, j = _kept_pairs(key, mine, _signatures(parts, 6), least)
            if not len(i):
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for p in parts for x in p.column(8).to_pylist()]
            n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            both = minhash.exact_overlaps(sets, i, j)
            near = both >= threshold * (n[i] + n[j] - both) - 1e-9
            i, j = i[near], j[near]
            if not len(i):
                continue
            linked = np.bincount(i, weights=size[j], minlength=len(h)) + np.bincount(j, weights=size[i], minlength=len(h))
            root = _least_connected(rep, i, j)
            some = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[some]), pa.array(rep[some]), pa.array(linked[some].astype(np.int64)), pa.array(root[some])],
                names=["h", "rep", "linked", "root"])

    return map_batches(rows, run, "h bigint, rep bigint, linked bigint, root bigint")


def _least_connected(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the least ``rep`` that it is connected with through the pairs."""
    root = rep.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(v, root): connected components of (u, v) edges, by alternating large-star and small-star steps."""
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   "join-edges")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small, "join-edges")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        state = new


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                   tolerance: float = TOLERANCE) -> DataFrame:
    """(id, class_id, copy_id, n_links), one row per input row.

    ``class_id``: smallest id of the group of documents connected by links; ``copy_id``: smallest id
    with the same shingle set; ``n_links``: other documents with similarity >= threshold.
    """
    least = minhash.least_matches(threshold, tolerance)
    rows = stored(sketches(df, id_col, text_col), "join-sketches")
    classes = stored(classes_of(rows), "join-classes")
    members = stored(memberships(classes), "join-members")
    kept = stored(prune(members, classes, least), "join-kept")
    wanted = classes.join(kept.select("h").distinct(), "h").select("h", "rep", "k1", "k2")
    sets = stored(sets_of(df, stored(wanted, "join-wanted"), id_col, text_col), "join-sets")
    found = stored(verify(kept, classes, sets, least, threshold), "join-found")
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("h").agg(F.sum("linked").alias("linked"))
    # only classes with copies or links need a look-up
    known = classes.select("h", "k1", "k2", "rep", "size").join(links, "h", "left") \
        .join(roots.withColumnRenamed("v", "rep"), "rep", "left").filter("size > 1 or linked is not null") \
        .select("k1", "k2", "rep", F.coalesce("root", "rep").alias("root"),
                (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    return rows.select("id", "k1", "k2").join(known, (rows["k1"] == known["k1"]) & (rows["k2"] == known["k2"])
                                              & rows["id"].isNotNull(), "left").select(
        F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), F.coalesce("rep", "id").alias("copy_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
