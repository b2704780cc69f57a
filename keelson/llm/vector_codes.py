"""Vector code compression: product-quantizer codes learned by Lloyd rounds over cover trees.

Components become whole numbers floor(SCALE * x), a vector is cut into ``parts``
equal parts, and each part position has a codebook.  Tasks build one cover tree per
part position over a bounded chunk of rows and store the trees; a round reads them,
gives whole subtrees to entries by the triangle inequality and returns exact sums per
entry.  Only codebooks and their sums (parts x entries) meet on the driver.

Contract for odd input: rows with a null or empty vector or one that holds null or
non-finite components are dropped, and so are vectors of another length than the
commonest; a commonest length that ``parts`` does not divide is refused.  The start
entries are those of the smallest ids (null ids last, then by vector), fewer than
``entries`` if there are fewer rows.  Repeated rows count as often as they occur and get
the same code.  An empty table gives an empty result.  Components so large that the sum
of squared distances might not fit 64 bits (|x| >= 2**19 for 64 components) are refused.
Only the named columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .cover_tree import CoverTree
from .vectors import common_length, is_finite, matrix

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
CHUNK_BYTES = 8 << 20      # vectors (8 bytes a component) that one set of trees holds


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(vectors * scale)
    if len(x) and 4 * x.shape[1] * float(np.abs(x).max()) ** 2 >= 2.0 ** 62:
        raise ValueError("components are too large for exact 64-bit distances")
    return x.astype(np.int64)


def build_trees(vectors: DataFrame, d: int, parts: int, scale: int) -> DataFrame:
    """(ids, labels, trees): per chunk of rows its ids and labels, and per part position a packed tree with row places."""
    most = max(1, CHUNK_BYTES // (8 * d))
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("id", "label"))

    def trees_of(x: np.ndarray) -> list[bytes]:
        packed = []
        for part in np.split(x, parts, axis=1):
            tree, place = CoverTree.build(part)
            packed.append(pickle.dumps((tree.packed(), place.astype(np.int32)), protocol=5))
        return packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, labels, vecs = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
            ends = pa.array([0, len(ids)], pa.int32())
            trees = trees_of(whole_numbers(matrix(vecs, d), scale))
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels),
                 pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

        for b in batches:
            for s in range(0, b.num_rows, most):
                piece = b.slice(s, most)
                if size + piece.num_rows > most:
                    yield flush()
                    held, size = [], 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield flush()

    return map_batches(vectors.select("id", "label", "vec"), run,
                       f"ids array<{id_type}>, labels array<{label_type}>, trees array<binary>")


def _trees(row: list[bytes]) -> Iterator[tuple[CoverTree, np.ndarray]]:
    for blob in row:
        packed, place = pickle.loads(blob)
        yield CoverTree(*packed), place


def entry_sums(trees: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(part, entry): (count, sums)} over all rows; tasks send parts x entries rows, so does the total."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(e), width + 1), dtype=np.int64) for e in books]
        for b in batches:
            for row in b.column(0).to_pylist():
                for p, (tree, _) in enumerate(_trees(row)):
                    total[p] += tree.assign(books[p])[1]
        for p, t in enumerate(total):
            used = np.flatnonzero(t[:, 0])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)),
                     pa.array(t[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    rows = map_batches(trees.select("trees"), run, "part int, entry int, sums array<bigint>")
    sums = rows.groupBy("part", "entry").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 1)]).alias("s"))
    return {(r["part"], r["entry"]): (r["s"][0], r["s"][1:]) for r in sums.collect()}


def moved(books: list[np.ndarray], sums: dict) -> list[np.ndarray]:
    """Every used entry at the componentwise floor of its parts' mean."""
    books = [b.copy() for b in books]
    for (part, entry), (count, total) in sums.items():
        books[part][entry] = [t // count for t in total]
    return books


def codes(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error): the nearest entries of every row in part order, and the squared distances' sum."""
    id_type, label_type = (trees.schema[c].dataType.elementType for c in ("ids", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = (b.column(c).slice(k, 1).flatten() for c in (0, 1))
                digits = np.empty((len(ids), len(books)), dtype=np.uint8)
                error = np.zeros(len(ids), dtype=np.int64)
                for p, (tree, place) in enumerate(_trees(b.column(2)[k].as_py())):
                    code = tree.assign(books[p])[0]
                    off = ((tree.points - books[p][code]) ** 2).sum(axis=1)
                    digits[:, p] = code[place]
                    error += off[place]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([bytes(row).hex() for row in digits]), pa.array(error)],
                    names=["id", "label", "code", "error"])

    return map_batches(trees.select("ids", "labels", "trees"), run,
                       f"id {id_type.simpleString()}, label {label_type.simpleString()}, code string, error bigint")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of every kept row, and the codebooks (one matrix of whole numbers a part)."""
    if not 1 <= entries <= 256:
        raise ValueError("an index must fit two hex digits: at most 256 entries")
    kept = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                     F.col(vec_col).cast("array<double>").alias("vec")).filter(is_finite(F.col("vec")))
    d = common_length(kept)
    if d is None:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    if d % parts:
        raise ValueError(f"vectors of {d} components cannot be cut into {parts} equal parts")
    kept = kept.filter(F.size("vec") == d)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    books = np.split(whole_numbers(np.array([r["vec"] for r in first]), scale), parts, axis=1)
    trees = stored(build_trees(kept, d, parts, scale), "code-trees")
    for _ in range(rounds):
        books = moved(books, entry_sums(trees, books))
    return codes(trees, books), books
