"""Relations between records: integrity and cascading deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling(relations: DataFrame, records: DataFrame) -> DataFrame:
    """(level, item, message) for each endpoint, blank ones apart, that is no record's id."""
    ids = records.select("record_id").distinct()
    parts = []
    for end, name in (("source_record", "source"), ("target_record", "target")):
        open_ends = relations.where((F.col(end) != "") & F.col(end).isNotNull()).join(ids, F.col(end) == F.col("record_id"), "left_anti")
        parts.append(open_ends.select(F.lit("warning").alias("level"), F.col("relation_id").alias("item"), F.concat(F.lit(f"Unknown {name} record: "), F.col(end)).alias("message")))
    return parts[0].unionByName(parts[1])


def cascade_delete(records: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records less those of `gone` (record_id), and relations less those that touch one."""
    ids = gone.select(F.col("record_id").alias("_gone")).distinct()
    left = records.join(ids, F.col("record_id") == F.col("_gone"), "left_anti")
    kept = relations.join(ids, F.col("source_record") == F.col("_gone"), "left_anti").join(ids, F.col("target_record") == F.col("_gone"), "left_anti")
    return left, kept
