"""keelson: schema-driven tabular regression on Spark.

Validation, reproducible splits, profiling, imputation, scaling, encoding,
feature selection, robust (Huber) regression, tuning and scoring, all
expressed as DataFrame / pyspark.ml / Structured Streaming jobs.

Quick start::

    from keelson import get_spark, DatasetSpec
    from keelson.plans.workflow import train, load_bundle, score_batch

    spark = get_spark()
    spec = DatasetSpec.from_json("schema.json")          # the dataset description
    result = train(spark.read.parquet("train/"), spec, artifacts_dir="/shared/models/run1",
                   run_tuning=True)
    preds = score_batch(spark.read.parquet("test/"), spec, load_bundle("/shared/models/run1"),
                        output_dir="/shared/predictions/run1")

or, from a CSV directory and JSON files in the reference's layout,
``keelson.plans.workflow.run_training`` / ``run_batch_predictions``; online
scoring: ``keelson.streaming.score_stream``.
"""

from keelson.session import get_spark, scratch_dir
from keelson.spec import DatasetSpec, Feature

__all__ = ["get_spark", "scratch_dir", "DatasetSpec", "Feature"]
