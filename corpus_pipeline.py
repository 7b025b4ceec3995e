"""A corpus pipeline of five stages: language, quality, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epigrain.llm import decontamination, language, near_duplicates, packing, site_quality
from epigrain.llm.shared import fresh, without, written

#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no learned language with confidence, go."""
    model = language.train(docs)
    name, score = fresh(docs, "language_name", "language_score")
    judged = language.predict(docs, model, out=(name, score))
    sure = (F.col(name) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return judged.where(sure).select(*docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely of low quality or toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality.judge(docs, labels).where("kept").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) one row stays, with the smallest doc_id; null is the largest."""
    once = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR doc_id IS NULL").isEmpty()
    if once:
        gone = near_duplicates.components(docs, width=5, similarity=0.8).where("NOT kept")
        return without(docs, F.col("doc_id"), gone.select("doc_id"))
    # ids do not tell the rows apart: numbers do, written so that they stay
    (row,) = fresh(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = near_duplicates.components(rows.select(F.col(row).alias("doc_id"), "text"), width=5, similarity=0.8)
    named = judged.select(F.col("doc_id").alias("row"), "component_id").join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    named = written(named, "components")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    kept = named.groupBy("component_id").agg(first.alias("row"))
    gone = named.join(kept, "row", "left_anti").select("row")
    return without(rows, F.col(row), gone).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_good_quality),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: The classifiers, the tiling and the tokenizer cannot be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
