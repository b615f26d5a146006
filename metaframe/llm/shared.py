"""Tables, scratch space and size-checked broadcasts that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType

from metaframe.scratch import clear, fresh_path, shared_dir, written

__all__ = ["bounded", "clear", "fresh_path", "shared_dir", "small", "table", "with_row", "written"]

#: Most bytes of a table that is broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of some megabytes, whatever the length of the rows, so that Python workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row(row: DataType, rest: str) -> StructType:
    """The schema of a struct `row`, whose fields may have any name, and other columns."""
    return StructType([StructField("row", row), *StructType.fromDDL(rest).fields])


def _bytes(df: DataFrame) -> Column:
    """The bytes of a row as Spark holds it: 8 for each column and row, and what strings and arrays have besides."""
    width = F.lit(8 + 8 * len(df.columns))
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            width = width + F.coalesce(8 * F.size(c), F.lit(0))
        elif isinstance(f.dataType, StringType | BinaryType):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
    return width.cast("long")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for a broadcast when its rows have `limit` bytes at most. It should be a written table, which is cheap to sum, with arrays of numbers at most."""
    size = df.agg(F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df
