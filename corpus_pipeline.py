"""A corpus pipeline of five operators; each stage's rows are a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridfuse.llm import common, stages
from gridfuse.session import ship


def _stage(function):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _stage(stages.quality)),
    ("simhash near-dedup", _stage(stages.near_duplicates)),
    ("suffix-array dedup", _stage(stages.repeated_passages)),
    ("benchmark decontamination", _stage(stages.decontamination)),
    ("packing", _stage(stages.packed)),
]

#: Fitted models, connected components and dynamic programming are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs, _ = common.cut(stage(spark, docs, sf_dir), "stage")
    return docs
