"""From raw documents to packed training sequences: each stage's table is written, and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, line_dedup, ngram_join, packing, quality
from weftline.llm.scratch import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels of the table ``labels``."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first line of each group of similar lines; one of which nothing is left goes."""
    return line_dedup.dedup_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of the table ``benchmark``."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", distinct_lines),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", without_benchmarks),
    ("best_fit_packing", packed),
]
#: The stages learn, hash and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", docs)  # what the stage before left is deleted then
    return STAGES[-1][1](spark, docs, sf_dir)
