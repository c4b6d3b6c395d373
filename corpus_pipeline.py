"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes documents and returns documents (the last one: their places in sequences). A null or empty text fails the
quality base; a component of near copies keeps its smallest doc_id; secrets are replaced by a mark; a source's budget repeats or
cuts its documents; every piece of what is left gets its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bin_packing, jaccard_join, secret_scan, source_mixing
from granary.llm import quality_rules as quality
from granary.llm.common import tune, written
from granary.llm.registry import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the risk-controlled cutoffs keep."""
    tune(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked shingle sets."""
    tune(spark)
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    tune(spark)
    return secret_scan.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents, repeated and cut to their budgets."""
    tune(spark)
    return source_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence."""
    tune(spark)
    return bin_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard), ("secret_scan", secrets), ("source_mixing", mixing), ("bin_packing", packing)]

#: Packing uses a tokenizer and a genetic algorithm, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
