"""Write PLANS.md: the physical plans of the key jobs, with what to look for.

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from keelson import get_spark  # noqa: E402
from keelson.functions.profile import frequency_table  # noqa: E402
from keelson.functions.topk import top_k_per_group  # noqa: E402

from keelson.operators.validate import duplicate_ids  # noqa: E402
from keelson.plans import catalog as C  # noqa: E402
from keelson.plans.workflow import predict  # noqa: E402
from keelson.sources.requests import parse_requests, score_requests  # noqa: E402


def plan_text(df, mode="formatted") -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    text = re.sub(r"#\d+L?", "", buf.getvalue())
    text = re.sub(r"\[plan_id=\d+\]", "", text)
    return re.sub(r"file:[^\]\s,]*/", "file:.../", text)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    ev = C.events_frame(spark, sf)
    df, bundle = C._literal_bundle(spark, sf)
    moments = ev.agg(*[a for c in ("value", "k", "target") for a in
                       (F.count(c), F.avg(c), F.var_pop(c), F.min(c), F.max(c))])
    labels = frequency_table(ev, ["event_type", "parity"])
    def sig(c):
        return F.sum(F.when(F.col(c).isNotNull(), F.xxhash64(c).bitwiseAND(F.lit(65535))))
    facts = ev.agg(F.count(F.lit(1)), *[a for c in ("value", "k") for a in
                   (F.count(c), F.min(c), F.max(c), sig(c))],
                   *[a for c in ("event_type", "parity") for a in
                     (F.count(c), F.min(F.xxhash64(c)), F.max(F.xxhash64(c)), sig(c))])
    freq = frequency_table(C.table(spark, sf, "part"), ["p_brand", "p_type"])
    from keelson.session import scratch_dir
    docs_path = scratch_dir(spark, "plan-requests")
    C._requests(spark, sf).write.parquet(docs_path)   # the request documents, as they would arrive
    docs = spark.read.parquet(docs_path)
    li = C.table(spark, sf, "lineitem")
    sections = [
        ("Scoring (score_batch): preprocessing + model + target inverse as one projection",
         "One WholeStageCodegen stage over the scan; ReadSchema holds only the 4 source columns used; "
         "no Exchange, no Python.", predict(bundle, df, C.events_spec()), "formatted"),
        ("Fit J1: numeric moments, one codegen-sized column chunk",
         "A global aggregate with a buffer under spark.sql.codegen.maxFields: partial aggregation inside "
         "one WholeStageCodegen stage per task, one row per task through the exchange.", moments, "formatted"),
        ("Fit J2: label counts",
         "Generate (explode to (column index, label)) feeds a partial HashAggregate keyed by (index, label) "
         "before the Exchange: a hot label is one row per task in the shuffle.", labels, "formatted"),
        ("Fit J3: column facts chunk (counts, extremes, duplicate signatures)",
         "Strings enter min/max only through xxhash64, so the buffer is fixed-width: HashAggregate with "
         "codegen, no sort aggregate; the signature is ID-free, so the chunk reads only its own columns.",
         facts, "formatted"),
        ("One-hot fit: salted top-k per column",
         "Two windows: the first partitioned by (column, hash bucket) so no task sorts a whole column; the "
         "second only sees <= buckets x k rows per column.",
         top_k_per_group(freq.where(F.col("value").isNotNull()), ["col"], [F.desc("cnt"), F.asc("value")], 10,
                         salt_cols=["value"]), "formatted"),
        ("Validation: duplicate-ID group-by",
         "The ID group-by aggregates map-side (partial_count) before its Exchange, so a hot ID is one row per "
         "task; only the ID column is read.",
         duplicate_ids(li, "l_orderkey").agg(F.sum(F.col("cnt") - 1)), "formatted"),
        ("Validation: fused rules (one chunk), run concurrently with the group-by",
         "count_if per rule in one global aggregate over the pruned scan.",
         li.agg(*[F.count_if(F.col(c).isNull()) for c in ("l_quantity", "l_extendedprice", "l_returnflag")]),
         "formatted"),
        ("Request scoring (batch or stream): one stateless projection per request row",
         "from_json + higher-order functions (exists / filter / transform) over the instances array; no "
         "Generate, no Exchange, no state.",
         score_requests(parse_requests(docs, C.request_spec(), "value", "requestId"), C.request_spec(),
                        [C._literal_predictor()]), "formatted"),
    ]
    out = ["# PLANS", "",
           "Physical plans of the key jobs (`tools/explain_plans.py`, sf0.01, local[8]; expression ids "
           "stripped). Regenerate after changing an operator.", ""]
    for title, note, frame, mode in sections:
        if frame is None:
            facts_plan = "(column_facts runs inside a collect; see `operators/selection.py`)"
            out += [f"## {title}", "", note, "", "```", facts_plan, "```", ""]
            continue
        out += [f"## {title}", "", note, "", "```", plan_text(frame, mode).strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
