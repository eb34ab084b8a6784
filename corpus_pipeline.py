"""A corpus pipeline of five of the operators: good documents, one of each group of near copies, without secrets, mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripmill.llm.common import Scratch, table
from tripmill.llm.mixing import mix_documents
from tripmill.llm.near_dedup import one_of_each
from tripmill.llm.packing import pack
from tripmill.llm.quality_classifier import keep_good
from tripmill.llm.secret_scan import redact_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Every stage is written as Parquet and read again as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(before)
    return docs
