"""Report frames derived from a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.functions import labels
from framegauge.functions.columns import column_dtypes
from framegauge.operators.column_profile import METRICS


def missing_total(columns: DataFrame) -> DataFrame:
    return columns.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_total"))


def missing_severity(columns: DataFrame) -> DataFrame:
    return columns.select("column", "missing", "missing_percent",
                          labels.missing_severity(F.col("missing_percent")).alias("severity"))


def missing_long(analyses: DataFrame, *keys: str) -> DataFrame:
    """The stored map of missing values as rows."""
    return (analyses.select(*keys, F.explode("missing_values").alias("column", "entry"))
            .select(*keys, "column", F.col("entry.count").alias("missing")))


def dtype_histogram(df: DataFrame) -> DataFrame:
    return column_dtypes(df).groupBy("kind").agg(F.count(F.lit(1)).alias("columns"))


def strong_correlations(correlations: DataFrame) -> DataFrame:
    """Pairs of different columns with a label, their value with two decimals."""
    return correlations.where(F.col("x") != F.col("y")).select(
        "x", "y", labels.fixed(F.col("corr"), 2).alias("shown"),
        labels.correlation_label(F.col("corr")).alias("strength"))


def statistics_pivot(statistics: DataFrame, columns: list[str], value: str = "text") -> DataFrame:
    """Metrics as rows, the given columns as columns."""
    return (statistics.where(F.col("metric").isin(*METRICS)).groupBy("metric")
            .pivot("column", columns).agg(F.first(value, ignorenulls=True)))


def correlation_pivot(correlations: DataFrame, columns: list[str]) -> DataFrame:
    """Square matrix; an absent pair is 0."""
    return (correlations.groupBy("x").pivot("y", columns).agg(F.first("corr"))
            .fillna(0.0, subset=columns))


def column_report(columns: DataFrame) -> DataFrame:
    """One printable row per column, absent numbers as "-"."""
    numeric = F.col("kind").isin("integer", "float", "decimal")

    def shown(name: str):
        return F.coalesce(F.when(numeric, labels.fixed(F.col(name), 2)), F.lit("-")).alias(name)

    return columns.select(
        "column", F.coalesce("kind", F.lit("-")).alias("dtype"),
        F.coalesce(F.col("unique").cast("string"), F.lit("-")).alias("unique"),
        F.coalesce("missing", F.lit(0)).alias("missing"), shown("mean"), shown("std"))
