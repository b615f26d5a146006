"""A corpus pipeline of the operators: each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaframe.llm import stages
from metaframe.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.without_toxic),
    ("line_dedup", stages.without_repeated_lines),
    ("ngram_join", stages.one_of_each_group),
    ("decontamination", stages.without_contaminated),
    ("packing", stages.packed),
]

#: Learned toxicity weights and MinHash signatures cannot be stated in SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep.

    Null and empty texts pass all stages (packing gives them the end token alone), and so do rows of a null id; an
    empty table gives an empty one. Rows that repeat an id are one document for line dedup and the n-gram join.
    Ties are decided by the least id, and by line number.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
