"""Tables written in numbered parts by ranges of a sort order, of which readers pick some."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parts(df: DataFrame, by: list[Column], part: str, part_rows: int, path: str) -> None:
    """``df`` in order, about ``part_rows`` rows to a part; ``part`` is the new column that numbers them.

    ``df`` is read three times (count, ranges, rows), so it should be a stored one.
    """
    parts = max(1, ceil(df.count() / part_rows))
    numbered = df.repartitionByRange(parts, *by).withColumn(part, F.spark_partition_id())
    numbered.sortWithinPartitions(part, *by).write.partitionBy(part).parquet(f"{path}/rows")
    # Rows may be none, and then no file tells the columns.
    numbered.limit(0).write.parquet(f"{path}/columns")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
