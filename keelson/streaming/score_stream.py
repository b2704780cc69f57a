"""score_stream: scoring requests with Structured Streaming.

Each input line is one request document.  Validation and scoring are one
stateless projection per request row (higher-order functions over the
``instances`` array), so the query has no shuffle, no watermark and no state
store; the fitted stages are plain literals in the plan.  Request IDs are a
hash of (source file, line), so a re-run micro-batch after a lost executor
produces the same responses.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keelson.sources.requests import content_key, parse_requests, score_requests
from keelson.spec import DatasetSpec


def stream_request_id() -> Column:
    """Full digest of a line's file, block start and text (equal lines of a file share it: responses are
    rows of their own, so nothing merges; only its first characters are shown)."""
    return content_key(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("value"))


def split_line(line: Column, separator: str) -> tuple[Column, Column]:
    """(request id, document) of ``<id><separator><document>``; a line without separator has a digest as id
    and is its own document, so it gets an error response instead of stopping the stream."""
    parts = F.split(line, separator, 2)
    whole = F.size(parts) < 2
    return F.when(whole, content_key(line)).otherwise(F.get(parts, F.lit(0))), \
        F.when(whole, line).otherwise(F.get(parts, F.lit(1)))


def score_stream(spark: SparkSession, source_dir: str, spec: DatasetSpec, bundle: PipelineModel,
                 sink_dir: str, checkpoint_dir: str, available_now: bool = True,
                 processing_time: str | None = None, sink_format: str = "json",
                 id_separator: str | None = None, max_files_per_trigger: int | None = None,
                 kafka_options: dict | None = None) -> StreamingQuery:
    """Start the stream.  Lines are request documents; with ``id_separator``
    (e.g. a tab) a line is ``<requestId><sep><document>``.  ``max_files_per_trigger``
    bounds the size of a micro-batch (also under ``availableNow``).
    ``kafka_options`` (e.g. ``{"kafka.bootstrap.servers": ..., "subscribe": ...}``)
    reads a Kafka topic instead of ``source_dir``; it needs Spark's Kafka
    connector on the classpath."""
    if kafka_options is not None:
        # records of a Kafka topic, one request document per record; the request ID
        # is a hash of (topic, partition, offset), stable across re-runs
        raw = spark.readStream.format("kafka").options(**kafka_options).load()
        lines = raw.select(F.col("value").cast("string").alias("value"),
                           content_key(F.col("topic"), F.col("partition"), F.col("offset")).alias("rid"))
        if id_separator:
            rid, document = split_line(F.col("value"), id_separator)
            lines = lines.select(document.alias("value"), rid.alias("rid"))
    else:
        reader = spark.readStream.format("text")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
        lines = reader.load(source_dir)
        if id_separator:
            rid, document = split_line(F.col("value"), id_separator)
            lines = lines.select(document.alias("value"), rid.alias("rid"))
        else:
            lines = lines.select("value", stream_request_id().alias("rid"))
    parsed = parse_requests(lines, spec, "value", request_id="rid")
    responses = score_requests(parsed, spec, bundle.stages)
    out = responses.select("requestId", "json", F.col("response.status").alias("status"))
    writer = (out.writeStream.format(sink_format).option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
