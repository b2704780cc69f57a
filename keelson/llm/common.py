"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import scratch_dir

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# Words of the pair and decontamination operators: digits, ASCII letters in lower case
# and everything outside ASCII; all else separates.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, ASCII letters lower-cased (None: no words)."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts (rows and bytes per batch)."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df.mapInArrow(_released(fn), schema)


def give_back() -> None:
    """Return to the system what the allocators of Arrow and C keep of freed memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn``, after which the worker gives freed memory back.

    Spark keeps a task's worker for later tasks, and idle ones beside stages without Python: without this
    each worker stays at the peak of all its tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def share(spark: SparkSession, value) -> Callable:
    """Broadcast ``value`` (of proven size, see the callers) for tasks; the result, called there, gives it."""
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(blob.value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back (cuts lineage)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sha256_of(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of every element, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
