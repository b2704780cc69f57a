"""Document fingerprints (``multiset``) over tables, and the comparison with each next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored
from .multiset import Fingerprints

# hashes travel and are stored as bytes, half the size of their hex texts
RESULT = ("n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")
_HASHES = ("edited_sha256", "fingerprint", "edited_fingerprint")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint), one row per input row; no shuffle.  Only the named columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(Fingerprints.of(b.column(1).to_pylist()).hex())],
                                             names=[b.schema.names[0], "fingerprint"])

    narrow = df.select(df[id_col], df[text_col].alias("__text"))
    return map_batches(narrow, run, f"`{id_col}` {narrow.dtypes[0][1]}, fingerprint string")


def compare(texts: list[str], following: list[str]) -> dict[str, list]:
    """Results of documents against the documents that follow them."""
    cuts = [len(t) // 3 for t in texts]
    edited = [t[:len(t) - c] + n[:c] for t, c, n in zip(texts, cuts, following, strict=True)]
    own, new, after = Fingerprints.of(texts), Fingerprints.of(edited), Fingerprints.of(following)
    return {"n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8")).digest() for t in edited],
            "fingerprint": own.packed(), "edited_fingerprint": new.packed(),
            "near_edited": own.likeness(new).tolist(), "near_next": own.likeness(after).tolist()}


_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _result(columns: dict[str, list]) -> list[pa.Array]:
    return [pa.array(v, t) for v, t in zip(columns.values(), _TYPES, strict=True)]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against the next one in descending id order (after the last: the first).

    Nulls sort last; rows of one id are ordered by a hash of the text, then the text.  One range
    exchange sorts the rows; tasks stream over their range and hold one batch.  The last row of a
    range meets the first one of the next range in a second, small step (two rows a partition).
    """
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranges = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    id_sql = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        id_type = held = None

        def out(ids, results, edge, text):
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *results, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()),
                 pa.array([text] * n, pa.string())],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                       "near_next", "part", "edge", "text"])

        nothing = [pa.nulls(1, t) for t in _TYPES]
        for b in batches:
            ids, texts, id_type = b.column(0).to_pylist(), b.column(1).to_pylist(), b.schema.field(0).type
            if not ids:
                continue
            if held is None:
                yield out(ids[:1], nothing, "first", texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                yield out(ids[:-1], _result(compare(texts[:-1], texts[1:])), None, None)
        if held is not None:
            yield out([held[0]], nothing, "last", held[1])

    made = stored(map_batches(ranges, run, f"id {id_sql}, {RESULT}, part int, edge string, text string"),
                  "compare-next")
    # at most two edge rows a partition: few enough for one ordered window
    edges = made.filter("edge is not null").select("id", "part", "edge", "text")
    firsts = edges.filter("edge = 'first'").select("part", "text")
    everything = Window.partitionBy().orderBy("part")
    after = firsts.select((F.lag("part").over(everything)).alias("part"), F.col("text").alias("following"))
    around = firsts.orderBy("part").limit(1).select(F.col("text").alias("around"))
    pairs = edges.filter("edge = 'last'").join(after, "part", "left").crossJoin(F.broadcast(around)) \
        .select("id", "text", F.coalesce("following", "around").alias("following"))     # `around` is one row

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *_result(compare(b.column(1).to_pylist(), b.column(2).to_pylist()))],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    both = made.filter("edge is null").select(*columns).unionByName(map_batches(pairs, join_edges, f"id {id_sql}, {RESULT}"))
    return both.select(F.col("id").alias(id_col), *[F.lower(F.hex(c)).alias(c) if c in _HASHES else F.col(c)
                                                    for c in columns[1:]])
