"""The text operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bin_packing, chat_format, common, hamming_search, jaccard_join, perplexity, quality_rules, secret_scan, source_mixing, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.tune(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op1_quality_rules"] = quality_rules.SQL


@query
def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op9_source_mixing(spark, sf_dir):
    return source_mixing.mix(table(spark, sf_dir, "documents"))


SQL["op9_source_mixing"] = source_mixing.SQL


@query
def op10_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_turns(turns.unionByName(chat_format.escape_probe(turns))))


SQL["op10_chat_format"] = chat_format.SQL


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


SQL["op5_jaccard_join"] = jaccard_join.SQL


@query
def op4_bin_packing(spark, sf_dir):
    return bin_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op2_hamming_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return hamming_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


SQL["op2_hamming_search"] = hamming_search.SQL


@query
def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op7_perplexity(spark, sf_dir):
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
