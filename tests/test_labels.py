from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framegauge.functions import labels
from framegauge.plans import report


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("size, label, short", [
    (1023, "1023 B", "1023 B"), (1024, "1.00 KB", "1.0 KB"), (1536, "1.50 KB", "1.5 KB"), (1029, "1.00 KB", "1.0 KB"),
    (1024 ** 2, "1.00 MB", "1.0 MB"), (1024 ** 3 - 1, "1024.00 MB", "1024.0 MB"), (5 * 1024 ** 3, "5.00 GB", "5120.0 MB")])
def test_size_label(spark, size, label, short):
    assert value(spark, labels.size_label(F.lit(size).cast("bigint"))) == label
    assert value(spark, labels.size_label(F.lit(size).cast("bigint"), 1, "MB")) == short


@pytest.mark.parametrize("score, label, band, range_", [
    (90, "Excellent dataset quality", "green", "90-100"), (80, "Excellent dataset quality", "yellow", "80-89"),
    (79, "Dataset needs cleaning", "yellow", "70-79"), (69, "Dataset needs cleaning", "red", "60-69"),
    (49, "Poor dataset quality", "red", "<60")])
def test_score_labels(spark, score, label, band, range_):
    s = F.lit(score)
    assert value(spark, labels.quality_label(s)) == label
    assert value(spark, labels.quality_band(s)) == band
    assert value(spark, labels.score_range(s)) == range_


@pytest.mark.parametrize("percent, band", [(50.01, "high"), (50.0, "medium"), (20.0, "low"), (0.01, "low"), (0.0, "none")])
def test_missing_severity(spark, percent, band):
    assert value(spark, labels.missing_severity(F.lit(percent))) == band


def test_other_labels(spark):
    assert value(spark, labels.correlation_label(F.lit(0.7))) == "neutral"
    assert value(spark, labels.correlation_label(F.lit(-0.71))) == "negative"
    assert value(spark, labels.date_label(F.lit(datetime(2024, 2, 3)))) == "03 Feb 2024"
    assert value(spark, labels.duplicate_advice(F.lit(0))) == "No duplicate rows found."
    assert value(spark, labels.kilobyte_label(F.lit(100))) == "0.10 KB"
    names = spark.createDataFrame([("Ab_c",), ("abXc",)], "name string")
    assert [r[0] for r in names.where(labels.name_contains(F.col("name"), "B_C")).collect()] == ["Ab_c"]


def test_pivots(spark):
    corr = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 1.0)], "x string, y string, corr double")
    found = {r["x"]: r for r in report.correlation_pivot(corr, ["a", "b"]).collect()}
    assert (found["a"]["b"], found["b"]["a"]) == (0.5, 0.0)
    stats = spark.createDataFrame([("a", "mean", "2.0"), ("b", "mean", None), ("a", "top", None)], "column string, metric string, text string")
    rows = {r["metric"]: r for r in report.statistics_pivot(stats, ["a", "b"]).collect()}
    assert (rows["mean"]["a"], rows["mean"]["b"], rows["top"]["a"]) == ("2.0", None, None)
