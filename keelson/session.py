"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # concurrent jobs (column chunks, tuning fits) share the cores instead of queueing
    "spark.scheduler.mode": "FAIR",
}


def get_spark(master: str | None = None, app: str = "keelson", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is.  Only
    when it is unset (local tests) do we create one of our own.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not conf_dir:
        conf_dir = sc.getCheckpointDir()
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder "
                             "that every executor and the driver share")
        conf_dir = tempfile.mkdtemp(prefix="keelson-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df):
    """``df`` dealt out over the session's cores if its files would give fewer tasks than that, else as it is.

    A file of one row group is one task however many columns are derived from its rows.  At most
    cores x ``spark.sql.files.maxPartitionBytes`` of files are dealt out; larger inputs have tasks enough.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    cores = spark.sparkContext.defaultParallelism
    if size >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    return df.repartition(cores)


STAGED_FILE_BYTES = 16 << 20


def staged(df, name: str):
    """Write ``df`` once under the shared checkpoint folder as Parquet and read it back.

    Later jobs read only the columns they need and never recompute or reparse the input.
    Files are kept near ``STAGED_FILE_BYTES`` (8 bytes a value) so that they spread over cores.  Floating-point
    columns get no dictionary (a dotted name keeps it): their values hardly repeat, and building one took most of a wide
    table's write.
    """
    path = scratch_dir(df.sparkSession, name)
    rows = max(1000, STAGED_FILE_BYTES // (8 * max(1, len(df.columns))))
    plain = {f"parquet.enable.dictionary#{c}": "false" for c, kind in df.dtypes if kind in ("double", "float")}
    df.write.option("maxRecordsPerFile", rows).options(**plain).parquet(path)
    return df.sparkSession.read.parquet(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so that local checks can use ``os``."""
    return path[5:] if path.startswith("file:") else path


def exists_local(path: str) -> bool:
    return os.path.exists(local_path(path))
