"""Train on the `events` test table and score it, batch and streaming.

usage: python examples/train_and_score.py [sf_dir] [work_dir]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keelson import get_spark  # noqa: E402
from keelson.plans import catalog as C  # noqa: E402
from keelson.session import scratch_dir  # noqa: E402
from keelson.plans.workflow import load_bundle, score_batch, train  # noqa: E402
from keelson.sources.requests import requests_from_table  # noqa: E402
from keelson.streaming import score_stream  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[4]", shuffle_partitions=8)
    work = sys.argv[2] if len(sys.argv) > 2 else scratch_dir(spark, "example")      # in the shared folder
    spark.sparkContext.setLogLevel("ERROR")
    data, spec = C.events_frame(spark, sf), C.events_spec()

    res = train(data, spec, artifacts_dir=f"{work}/artifacts", run_tuning=True, tune_kwargs=dict(num_trials=6))
    print("features:", res.preprocess.feature_cols)
    print("dropped:", {k: v for k, v in res.preprocess.report.items() if k != "one_hot"})
    print("best hyperparameters:", res.tuning.best_params, "validation R^2:", round(res.r2_validation, 4))

    bundle = load_bundle(f"{work}/artifacts")
    preds = score_batch(data.drop("target"), spec, bundle, output_dir=f"{work}/predictions")
    preds.show(5)

    docs = requests_from_table(data, spec, F.expr("event_id div 100"))
    docs.select(F.concat_ws("\t", "requestId", "value").alias("value")).write.text(f"{work}/requests")
    q = score_stream(spark, f"{work}/requests", spec, bundle, f"{work}/responses", f"{work}/checkpoint",
                     id_separator="\t")
    q.awaitTermination()
    spark.read.json(f"{work}/responses").groupBy("status").count().show()
    print("outputs under", work)


if __name__ == "__main__":
    main()
