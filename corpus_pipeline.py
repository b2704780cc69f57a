"""Corpus pipeline: language, near copies, benchmark passages, secrets, tokens.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes each
result as Parquet under the shared checkpoint folder and rereads it for the
next.  All stages but the last return the columns of ``documents``:

1. ``language``: rows whose language is rejected go (no letters, or a best
   language that holds less than ``LEAST_SCORE`` of the score).
2. ``near_copies``: of each group of near copies (five-word shingles, 0.8) the
   document with the smallest id stays, of rows with that id or of rows without any id
   (they come last) the first stored one; rows without shingles have no copies and stay.
3. ``decontaminate``: benchmark passages are cut out of the texts; a text of
   which nothing but separators is left goes.
4. ``secrets``: confirmed and patterned secrets are replaced by ``[SECRET]``.
5. ``tokens``: the texts as token ids.

``n_chars`` follows the text.  Rows without a change pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, decontam, langid, ngram_join, secrets
from keelson.llm.common import stored, table
from keelson.llm.queries import tokenizer_path

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    return langid.predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)) \
        .select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids may be null or repeated, so rows are told apart by a stored key
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    grouped = ngram_join.jaccard_groups(rows, "__row").filter("n_links > 0").select("__row", "class_id")
    grouped = stored(grouped.join(rows.select("__row", "doc_id"), "__row"), "pipeline-groups")
    first = grouped.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("f")) \
        .select(F.col("f.__row").alias("__row"))
    copies = stored(grouped.join(first, "__row", "left_anti").select("__row"), "pipeline-copies")
    return rows.join(copies, "__row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs, length_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, tokenizer_path(), keep=("lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate),
          ("secrets", clean_secrets), ("tokens", tokens)]

ORACLE_SQL = None      # the stages are tested one by one and together against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
