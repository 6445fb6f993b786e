"""The training-data pipeline: each stage reads what its predecessor wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, near_dedup, token_output, toxicity
from graphloom.llm.common import table
from graphloom.storage import scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents; the lexicon is learned from the labelled rows of docs. Null and empty
    texts and repeated rows that aren't toxic stay; without labels the built-in list decides; an
    empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of the smallest doc_id, then the
    first row. Null and blank texts are in no group and stay; an empty table stays empty."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test string of the benchmark. Null and empty texts and repeated
    rows without one stay; an empty benchmark drops nothing; an empty table stays empty."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that fit the sources' token budgets. Null and empty texts have no tokens
    and go; repeated rows count each; a null source is a source; an empty table stays empty."""
    return mixing.keep_mixed(docs)


def token_output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, token counts and directly addressable codes, a row for each row of docs;
    null and empty texts have 0 tokens and an empty code."""
    return token_output.token_output(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_output", token_output_stage),
]

#: tokenizing and minhashing can't be said in SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        where = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
