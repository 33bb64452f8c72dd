"""Corpus pipeline: documents through a chain of text operators, each stage written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, mixing, neardup, quality, token_store
from millrace.llm.common import written

STAGES = [
    ("quality", quality.stage),
    ("near duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token store", token_store.stage),
]

#: Its stages fit models and build stores, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
