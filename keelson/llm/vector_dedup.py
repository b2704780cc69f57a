"""Near-duplicate vectors by PCA-ordered tiled comparison.

1. Equal vectors become one *point* (how many rows, least id), so copies are never paired.
2. Directions are turned into the principal axes of their second moments, strongest first.
3. Points are range-sorted by a Z-order key of their leading coordinates and cut into blocks;
   a block knows the box of its leading coordinates and the largest norm of what follows them.
4. Block pairs whose boxes cannot hold a pair above the threshold are left out.  The others meet in
   tasks of one strip of blocks against one slice of blocks.
5. A tile of two blocks compares the leading ``LEAD`` coordinates of all pairs at once, with the
   suffix norms as one more coordinate: the product then *is* the bound of the cosine.  Pairs that
   cannot reach the threshold stop there; the others go on with twice the coordinates, and so on; full
   products decide, those within ``CLOSE`` of the threshold anew from the original components.
6. Tasks return, per point, the rows it is linked with and one spanning edge.  Connected components of the
   edges give the groups.

Every pair with cosine >= threshold (doubles) is found, at any size; none is sampled.

Contract for odd input: vectors that are null, empty, all zero or hold null or non-finite components link with
nothing, and so do vectors of another length than the commonest of the others.  Repeated rows are vectors of their
own that link with each other.  Null ids count as links, but never as the least id; a group of null ids only has
a null component and all its rows are kept.  An empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, share, stored
from .ngram_join import components
from .vectors import common_length, is_finite, matrix, outer_sum

THRESHOLD = 0.9
LEAD = 16              # coordinates of the first comparison
BOX = 8                # coordinates of a block's box and of the sort key
BLOCK = 1024           # points of a block
STRIP = 8              # blocks of a strip
SLICE = 4              # strips whose blocks meet a strip in one task
CLOSE = 1e-9           # products this near the threshold are decided from the original components
DENSE = 0.05           # share of a tile's pairs above which all of them get full products at once


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(points: DataFrame, d: int) -> np.ndarray:
    """Orthonormal axes (columns) of the directions' second moments, strongest first."""
    moments = outer_sum(points.select("vec"), d, lambda b: directions(matrix(b.column(0), d)))
    _, axes = np.linalg.eigh(moments)
    return np.ascontiguousarray(axes[:, ::-1])


def _z_order(lead: np.ndarray, bits: int = 7) -> np.ndarray:
    """Interleaved leading bits of coordinates in [-1, 1], the strongest axis first."""
    cells = np.clip((lead + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64)
    key = np.zeros(len(lead), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(lead.shape[1]):
            key = key << 1 | (cells[:, k] >> bit & 1)
    return key


def blocks_of(points: DataFrame, d: int, axes) -> DataFrame:
    """(block, strip, slice, low, high, rest, hs, sizes, data): blocks of points in Z-order.

    Numbers rise along the order.  ``data`` holds the original components (doubles), ``low`` / ``high`` the box of the
    leading coordinates and ``rest`` the largest norm of the remaining ones.  Store the result before use.
    """
    lead = min(BOX, d)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = axes()[:, :lead]
        for b in batches:
            if b.num_rows:
                key = _z_order(directions(matrix(b.column(2), d)) @ turn)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", "h", "size", "vec"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, seq = axes()[:, :lead], [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            x = matrix(rows.column(2).combine_chunks(), d)
            y = directions(x) @ turn
            rest = np.sqrt(np.maximum(1 - (y * y).sum(axis=1), 0)).max()
            ends = pa.array([0, len(x)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.int64()), pa.array([y.min(axis=0).tolist()], pa.list_(pa.float64())),
                 pa.array([y.max(axis=0).tolist()], pa.list_(pa.float64())), pa.array([rest]),
                 pa.ListArray.from_arrays(ends, rows.column(0).combine_chunks()),
                 pa.ListArray.from_arrays(ends, rows.column(1).combine_chunks()), pa.array([x.tobytes()], pa.binary())],
                names=["seq", "low", "high", "rest", "hs", "sizes", "data"])

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, BLOCK))
                held, seq = rows.slice(BLOCK).to_batches(), seq + 1
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held))

    tasks = max(1, -(-points.count() // (BLOCK * STRIP)))
    sorted_ = map_batches(points.select("h", "size", "vec"), keyed, "key bigint, h bigint, size bigint, vec array<double>") \
        .repartitionByRange(tasks, "key", "h").sortWithinPartitions("key", "h").select("h", "size", "vec")
    made = map_batches(sorted_, cut, "seq bigint, low array<double>, high array<double>, rest double, "
                                     "hs array<bigint>, sizes array<bigint>, data binary")
    part = F.spark_partition_id().cast("bigint")
    strip = part * (1 << 24) + F.floor(F.col("seq") / STRIP)
    return made.select((part * (1 << 32) + F.col("seq")).alias("block"), strip.alias("strip"),
                       F.floor(part / SLICE).alias("slice"), "low", "high", "rest", "hs", "sizes", "data")


def _most(a: str, b: str, k: int) -> Column:
    """An upper bound of the cosine of any two points of two boxes with ``k`` leading coordinates."""
    def products(i: int) -> Column:
        return F.greatest(*[F.col(f"{a}.{x}")[i] * F.col(f"{b}.{y}")[i] for x in ("low", "high") for y in ("low", "high")])
    total = F.col(f"{a}.rest") * F.col(f"{b}.rest")
    for i in range(k):
        total = total + products(i)
    return total


def block_pairs(blocks: DataFrame, d: int, threshold: float) -> DataFrame:
    """(strip, block): strips and the blocks, from their own on, that may hold a link with one of theirs.

    Points of a link differ by at most ``reach`` in the first coordinate: the strip's interval, wider by that much,
    and the block's share a bin; they meet in the first one that both touch.
    """
    k = min(BOX, d)
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-6
    width = max(reach, 1 / 16)
    facts = blocks.select("block", "strip", "low", "high", "rest")
    strips = facts.groupBy("strip").agg(
        F.array(*[F.min(F.col("low")[i]) for i in range(k)]).alias("low"),
        F.array(*[F.max(F.col("high")[i]) for i in range(k)]).alias("high"), F.max("rest").alias("rest"))

    def bins(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / width), F.floor(high / width))

    left = strips.select("*", F.explode(bins(F.col("low")[0] - reach, F.col("high")[0] + reach)).alias("bin")).alias("s")
    right = facts.select("*", F.explode(bins(F.col("low")[0], F.col("high")[0])).alias("bin")).alias("b")
    first = F.floor(F.greatest(F.col("s.low")[0] - reach, F.col("b.low")[0]) / width)
    return left.join(right, (F.col("s.bin") == F.col("b.bin")) & (F.col("s.bin") == first)
                     & (F.col("b.strip") >= F.col("s.strip")) & (_most("s", "b", k) >= threshold - 1e-6)) \
        .select(F.col("s.strip").alias("strip"), F.col("b.block").alias("block"))


class Tile:
    """The points of one block, turned and ready for comparison."""

    def __init__(self, data: bytes, axes: np.ndarray):
        d = len(axes)
        x = np.frombuffer(data, dtype=np.float64).reshape(-1, d)
        self.x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])     # exact; squares stay in range
        self.y = directions(self.x) @ axes
        # norms of what follows the first k coordinates, for every k
        self.rest = np.sqrt(np.maximum(np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1], 0))
        lead = min(LEAD, d)
        self.first = self.y[:, :lead].astype(np.float32)
        if lead < d:
            self.first = np.column_stack([self.first, self.rest[:, lead].astype(np.float32)])


def linked_pairs(a: Tile, b: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with cosine >= threshold; i < j if both are one tile."""
    d = a.y.shape[1]
    at = min(LEAD, d)
    bound = a.first @ b.first.T >= np.float32(threshold - 1e-5)       # single precision: a margin far above its error
    if same:
        bound &= np.tri(len(a.y), len(b.y), -1, dtype=bool).T
    if np.count_nonzero(bound) > DENSE * bound.size:
        product = a.y @ b.y.T
        i, j = np.nonzero(bound & (product >= threshold - CLOSE))
        product = product[i, j]
    else:
        i, j = np.nonzero(bound)
        product = np.einsum("ij,ij->i", a.y[i, :at], b.y[j, :at])
        while at < d and len(i):
            to = min(2 * at, d)
            product += np.einsum("ij,ij->i", a.y[i, at:to], b.y[j, at:to])
            at = to
            left = a.rest[i, at] * b.rest[j, at] if at < d else 0.0
            go = product + left >= threshold - CLOSE
            i, j, product = i[go], j[go], product[go]
        go = product >= threshold - CLOSE
        i, j, product = i[go], j[go], product[go]
    near = np.flatnonzero(np.abs(product - threshold) <= CLOSE)
    if len(near):
        p, q = a.x[i[near]], b.x[j[near]]
        exact = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
        product[near] = exact
        go = product >= threshold
        i, j = i[go], j[go]
    return i, j


class _Links:
    """Linked rows and a spanning forest over the points that one task compares."""

    def __init__(self):
        self.linked: dict[int, np.ndarray] = {}
        self.hs: dict[int, np.ndarray] = {}
        self.edges: list[np.ndarray] = []

    def add(self, block: int, hs: np.ndarray) -> None:
        if block not in self.hs:
            self.hs[block], self.linked[block] = hs, np.zeros(len(hs), dtype=np.int64)

    def count(self, block: int, places: np.ndarray, sizes: np.ndarray) -> None:
        self.linked[block] += np.bincount(places, weights=sizes, minlength=len(self.hs[block])).astype(np.int64)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        """Keep of the pairs' edges no more than one a point."""
        if len(u):
            self.edges.append(_forest(u, v))
            if sum(map(len, self.edges)) > 1 << 20:
                both = np.concatenate(self.edges)
                self.edges = [_forest(both[:, 0], both[:, 1])]

    def batch(self) -> pa.RecordBatch | None:
        if not self.edges:
            return None
        both = np.concatenate(self.edges)
        forest = _forest(both[:, 0], both[:, 1])
        hs, linked = np.concatenate(list(self.hs.values())), np.concatenate(list(self.linked.values()))
        some = linked > 0
        hs, linked = hs[some], linked[some]
        order = np.argsort(forest[:, 0])
        at = np.searchsorted(forest[order, 0], hs)
        return pa.RecordBatch.from_arrays([pa.array(hs), pa.array(linked), pa.array(forest[order[at], 1])],
                                          names=["h", "linked", "root"])


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(node, least node of its component) for every node of the edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return np.column_stack([nodes, nodes[root]])
        root = new


def compared(blocks: DataFrame, pairs: DataFrame, d: int, axes, threshold: float) -> DataFrame:
    """(h, linked, root): per task and point, the rows it is linked with there, and a spanning edge."""
    wanted = pairs.join(blocks.select("block", "slice", F.col("strip").alias("own")), "block")
    # a strip's own blocks come first in each of its tasks; one that is also a partner is marked as such
    homes = wanted.select("strip", "slice").distinct().join(blocks.select("strip", "block"), "strip") \
        .select("strip", "slice", "block", F.lit(0).alias("role"))
    rows = homes.unionByName(wanted.select("strip", "slice", "block", F.lit(1).alias("role")))
    rows = rows.join(blocks.select("block", "hs", "sizes", "data"), "block") \
        .repartition("strip", "slice").sortWithinPartitions("strip", "slice", "role", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = axes()
        key, own, links = None, {}, None
        for b in batches:
            strips, slices, roles, names = (b.column(c).to_pylist() for c in range(4))
            for k in range(b.num_rows):
                if (strips[k], slices[k]) != key:
                    if links is not None and (out := links.batch()) is not None:
                        yield out
                    key, own, links = (strips[k], slices[k]), {}, _Links()
                hs, sizes = (b.column(c).slice(k, 1).flatten().to_numpy() for c in (4, 5))
                if roles[k] == 0:
                    own[names[k]] = (Tile(b.column(6)[k].as_py(), turn), hs, sizes)
                    continue
                mine = own.get(names[k])
                tile = mine[0] if mine else Tile(b.column(6)[k].as_py(), turn)
                links.add(names[k], hs)
                for name, (other, other_hs, other_sizes) in own.items():
                    if name > names[k]:
                        continue
                    i, j = linked_pairs(other, tile, threshold, name == names[k])
                    if len(i):
                        links.add(name, other_hs)
                        links.count(name, i, sizes[j])
                        links.count(names[k], j, other_sizes[i])
                        links.join(other_hs[i], hs[j])
        if links is not None and (out := links.batch()) is not None:
            yield out

    return map_batches(rows.select("strip", "slice", "role", "block", "hs", "sizes", "data"), run,
                       "h bigint, linked bigint, root bigint")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row.

    ``n_links``: other rows with cosine >= threshold; ``component_id``: the least id reachable by links;
    ``kept``: whether the row has that id.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    some = rows.filter(is_finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    alone = rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"),
                        F.lit(True).alias("kept"))
    d = common_length(some)
    if d is None:
        return alone.withColumnRenamed("id", id_col)
    points = stored(some.filter(F.size("vec") == d).groupBy("vec").agg(F.count("*").alias("size"), F.min("id").alias("least"))
                    .withColumn("h", F.monotonically_increasing_id()), "vector-points")
    axes = share(df.sparkSession, principal_axes(points, d))         # d x d
    blocks = stored(blocks_of(points, d, axes), "vector-blocks")
    pairs = stored(block_pairs(blocks, d, threshold), "vector-tiles")
    found = stored(compared(blocks, pairs, d, axes, threshold), "vector-links")
    roots = components(found.select(F.col("h").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("h").agg(F.sum("linked").alias("linked"))
    known = stored(points.join(links, "h", "left").join(roots.withColumnRenamed("v", "h"), "h", "left")
                   .filter("size > 1 or linked is not null").withColumn("root", F.coalesce("root", "h")), "vector-known")
    least = stored(known.groupBy("root").agg(F.min("least").alias("component_id")), "vector-least")
    known = known.join(least, "root").select(
        F.col("vec").alias("v"), "component_id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.join(known, F.col("vec") == F.col("v"), "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
