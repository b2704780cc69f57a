"""Histogram sort: equal-byte shards of a total order, found by counting, exchanged once.

Splitters are refined on exact counts.  Each round sends candidate boundaries
(probes) to all partitions, which return the bytes and rows between probes; the
gaps that still hold a wanted splitter, or more than a bucket's share of bytes,
get evenly spaced probes in the next round.  Rounds end when every splitter is
within ``tolerance`` bytes of its target or its gap is a single key, so there
are at most 128 / log2(probes) of them.  Then every row goes straight to its
final bucket (a piece of one shard whose first slot is known from the counts):
one exchange, and no task ever holds a whole shard.

Order: null keys first, then ascending key, then a hash of all columns.  Rows
that are equal in everything share one key; they stay adjacent and a splitter
cannot fall between them.

Contract for odd input: an empty table gives an empty table; with fewer rows
than shards some shards stay empty; null sizes count as 0; ties in the key are
ordered by the row hash.  Result columns replace input columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, share, stored

PROBES = 64                # new probes a gap and round
MAX_PROBES = 200_000       # all probes of a round (their counts come to the driver)
PIECES = 16                # buckets a shard has at least, in bytes
BUCKET_BYTES = 64 << 20    # and at most so many bytes a bucket, however large the table
LIMIT = 1 << 128


def order_key(key: Column, tie: Column) -> Column:
    """16 bytes whose unsigned order is (null first, key, tie); key and tie are longs.

    The lowest key and a null share their high half; the tie of a null sorts by its own order.
    """
    flip = F.lit(-(1 << 63)).cast("bigint")
    def half(c: Column) -> Column:
        return F.lpad(F.hex(c.bitwiseXOR(flip)), 16, "0")
    return F.unhex(F.concat(half(F.coalesce(key.cast("bigint"), flip)), half(tie)))


def _keys(column: pa.Array) -> np.ndarray:
    """(high, low) halves of 16-byte keys as one comparable numpy array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="S16")


def _probe_array(probes: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(p.to_bytes(16, "big") for p in probes), dtype="S16")


def count_between(rows: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) in the gap before each probe, for all probes but those past the end."""

    blob = share(rows.sparkSession, _probe_array(probes).tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.frombuffer(blob(), dtype="S16")
        size, number = np.zeros(len(bounds) + 1, dtype=np.int64), np.zeros(len(bounds) + 1, dtype=np.int64)
        for b in batches:
            gap = np.searchsorted(bounds, _keys(b.column(0)), side="right")
            # sums of integers, exact: sort by gap and add up runs
            order = np.argsort(gap, kind="stable")
            gap, own = gap[order], b.column(1).to_numpy(zero_copy_only=False)[order]
            first = np.flatnonzero(np.diff(gap, prepend=-1))
            size[gap[first]] += np.add.reduceat(own, first) if len(first) else 0
            number += np.bincount(gap, minlength=len(number))
        some = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(number[some])],
                                         names=["gap", "size", "number"])

    parts = map_batches(rows.select("key", "size"), count, "gap bigint, size bigint, number bigint")
    size, number = np.zeros(len(probes) + 1, dtype=object), np.zeros(len(probes) + 1, dtype=object)
    # at most one row a probe comes to the driver
    for r in parts.groupBy("gap").agg(F.sum("size").alias("size"), F.sum("number").alias("number")).collect():
        size[r["gap"]], number[r["gap"]] = r["size"], r["number"]
    return size, number


def refine(rows: DataFrame, shards: int, tolerance: int) -> dict:
    """Buckets of the order: their lower bounds (ints), shards and first slots."""
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    low, high = (int.from_bytes(ends[x] or b"", "big") for x in ("low", "high"))
    probes = sorted({0, *(low + (high + 1 - low) * i // (4 * PROBES) for i in range(4 * PROBES)), high + 1})
    while True:
        size, number = count_between(rows, probes)
        size, number = size[1:], number[1:]                  # no key is below probe 0
        ends = [*probes[1:], LIMIT]
        total = int(size.sum())
        above = np.cumsum(size)                              # bytes up to the end of each gap
        below = above - size
        share_of = max(1, min(BUCKET_BYTES, total // (shards * PIECES)))
        wanted = [total * k // shards for k in range(1, shards)]
        # a splitter is done if a gap boundary lies within tolerance of its target
        open_gaps = set()
        for t in wanted:
            g = int(np.searchsorted(above.astype(np.int64), t, side="left"))
            if g < len(probes) and min(abs(int(above[g]) - t), abs(t - int(below[g]))) > tolerance:
                open_gaps.add(g)
        open_gaps |= {int(g) for g in np.flatnonzero(size > share_of)}
        open_gaps = sorted(g for g in open_gaps if ends[g] - probes[g] > 1 and number[g] > 1)
        if not open_gaps:
            break
        step = max(2, min(PROBES, (MAX_PROBES - len(probes)) // len(open_gaps)))
        # gaps that need no more probes keep their lower bound; empty ones merge into their neighbour
        fresh = []
        for g in open_gaps:
            width = ends[g] - probes[g]
            fresh += [probes[g] + width * i // step for i in range(1, step)]
        kept = [p for p, n in zip(probes, number, strict=True) if n]
        probes = sorted({0, *kept, *fresh})
    # shard of a bucket: the target interval that its first byte falls in
    shard = [min(shards - 1, int(b) * shards // total) if total else 0 for b in below]
    slot, used = [], {}
    for s, n in zip(shard, number, strict=True):
        slot.append(used.get(s, 0))
        used[s] = slot[-1] + int(n)
    return {"probes": probes, "shard": shard, "slot": slot}


def histogram_sort(df: DataFrame, key: str, size: Column, shards: int, tolerance: int = 0) -> DataFrame:
    """``df`` plus ``shard`` and ``slot`` (gapless from 0 in key order within the shard)."""
    df = df.drop("shard", "slot")
    columns = df.columns
    tie = F.xxhash64(*columns) if columns else F.lit(0).cast("bigint")
    keyed = df.withColumn("__key", order_key(F.col(key), tie)) \
        .withColumn("__size", F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")))
    rows = stored(keyed.select(F.col("__key").alias("key"), F.col("__size").alias("size")), "histogram-keys")
    plan = refine(rows, shards, tolerance)
    blob = share(df.sparkSession, (_probe_array(plan["probes"]).tobytes(), np.array(plan["shard"], dtype=np.int32),
                                   np.array(plan["slot"], dtype=np.int64)))   # at most MAX_PROBES buckets
    keyed = keyed.drop("__size")
    at = keyed.columns.index("__key")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, shard, slot = blob()
        bounds = np.frombuffer(bounds, dtype="S16")
        for b in batches:
            bucket = np.searchsorted(bounds, _keys(b.column(at)), side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(bucket.astype(np.int64)), pa.array(shard[bucket]), pa.array(slot[bucket])],
                names=[*b.schema.names, "__bucket", "shard", "slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    placed = map_batches(keyed, place, f"{fields}, __bucket bigint, shard int, slot bigint")
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key")) - 1
    return placed.withColumn("slot", F.col("slot") + inside).select(*columns, "shard", "slot")
