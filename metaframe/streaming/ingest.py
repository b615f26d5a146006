"""Files of records dropped into a folder, validated as they come. An extension: the messages are those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from metaframe.plans.compiler import validate_records
from metaframe.schema import RECORD_SCHEMA, Schema


def record_stream(spark: SparkSession, folder: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def validate_stream(records: DataFrame, schema: Schema, to: str, checkpoint: str) -> StreamingQuery:
    """Messages of a stream of records, appended to Parquet files; the plan is narrow, so there is no state."""
    return validate_records(records, schema).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(to)
