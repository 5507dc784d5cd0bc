"""The training-data pipeline over ``documents``: language, near-duplicates, benchmark
passages, mixing, token files. Every stage's result is written as Parquet to the shared
folder and read again, so a lost executor costs at most the stage that runs. What the stages
do with nulls, empty and very long texts, ties, repeated rows, empty tables and further
columns is stated in ``eraflow.llm.pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eraflow.llm import pipeline
from eraflow.llm import queries as _queries  # noqa: F401  (registers the operators' queries)
from eraflow.llm.common import store, table, work_dir
from eraflow.llm.registry import ORACLES, QUERIES

STAGES = [
    ("language", pipeline.known_language),
    ("near_duplicates", pipeline.without_copies),
    ("decontamination", pipeline.without_benchmark),
    ("mixing", pipeline.mixed),
    ("token_files", pipeline.token_files),
]

# The language stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "pipeline": run}


def oracles() -> dict[str, str]:
    return dict(ORACLES) | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
