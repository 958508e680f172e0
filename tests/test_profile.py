from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from framegauge.functions.columns import column_dtypes, numeric_columns
from framegauge.operators import column_profile as cp
from framegauge.operators.correlation import correlation_matrix
from framegauge.operators.duplicates import duplicate_rows
from framegauge.operators.quality import quality_score, summary_text
from framegauge.plans.table_profile import group_scores, profile_by_group, profile_table

NAN = float("nan")


def by_column(df):
    return {r["column"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, 1.5, "a", True, datetime(2024, 1, 1), Decimal("1.10")), (2, NAN, "b", None, datetime(2024, 1, 3), None),
            (3, None, "b", False, None, Decimal("1.10")), (None, 4.5, None, False, datetime(2024, 1, 2), Decimal("9.99"))]
    return spark.createDataFrame(rows, "i int, f double, s string, b boolean, t timestamp_ntz, d decimal(20,2)")


def test_missing_is_null_or_nan(mixed):
    found = by_column(cp.column_missing(mixed))
    assert {c: r["missing"] for c, r in found.items()} == {"i": 1, "f": 2, "s": 1, "b": 1, "t": 1, "d": 1}
    assert found["f"]["missing_percent"] == 50.0
    assert cp.missing_cells(mixed).first()[0] == 7


def test_kinds_and_numeric_columns(mixed):
    kinds = {r["column"]: r["kind"] for r in column_dtypes(mixed).collect()}
    assert kinds == {"i": "integer", "f": "float", "s": "string", "b": "boolean", "t": "datetime", "d": "decimal"}
    assert numeric_columns(mixed).columns == ["i", "f", "d"]


def test_unique_values(mixed):
    assert {c: r["unique"] for c, r in by_column(cp.column_unique(mixed)).items()} == {
        "i": 3, "f": 2, "s": 2, "b": 2, "t": 3, "d": 2}


def test_whole_numbers_beyond_double_precision_stay_distinct(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 2,)], "big bigint")
    assert cp.column_unique(df).first()["unique"] == 3
    wide = spark.createDataFrame([(Decimal("90071992547409.93"),), (Decimal("90071992547409.94"),)], "w decimal(38,2)")
    assert by_column(cp.column_profile(wide))["w"]["unique"] == 2


def test_describe_parts(mixed):
    number = by_column(cp.describe_numeric(mixed))["i"]
    assert (number["count"], number["mean"], number["std"], number["min"], number["q50"], number["max"]) == (3, 2, 1, 1, 2, 3)
    text = by_column(cp.describe_categorical(mixed))
    assert (text["s"]["top"], text["s"]["freq"]) == ("b", 2)
    assert (text["b"]["count"], text["b"]["top"], text["b"]["freq"]) == (3, "false", 2)
    time = cp.describe_temporal(mixed).first()
    assert (time["count"], time["mean"], time["max"]) == (3, datetime(2024, 1, 2), datetime(2024, 1, 3))


def test_top_tie_takes_the_smallest_value(spark):
    df = spark.createDataFrame([("z",), ("m",), ("z",), ("m",), ("q",)], "s string")
    assert cp.describe_categorical(df).first()["top"] == "m"


def test_describe_all_has_every_metric_for_every_column(mixed):
    rows = cp.describe_all(mixed).collect()
    assert len(rows) == 6 * 11
    cell = {(r["column"], r["metric"]): r for r in rows}
    assert cell["s", "mean"]["text"] is None and cell["i", "top"]["text"] is None
    assert cell["t", "min"]["text"] == "2024-01-01T00:00:00" and cell["t", "std"]["text"] is None


def test_quartiles_and_fences(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 4, 7, 11, 100, None)], "v int")
    row = cp.order_profile(df).first()
    assert (row["q25"], row["q50"], row["q75"]) == (2.5, 5.5, 10.0)
    assert (row["lower"], row["upper"], row["outliers"]) == (-8.75, 21.25, 1)
    assert [r["v"] for r in cp.outlier_rows(df, "v").collect()] == [100]


def test_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, none double")
    profile = by_column(cp.column_profile(df))
    assert (profile["none"]["missing"], profile["none"]["unique"], profile["none"]["outliers"]) == (2, 0, 0)
    assert profile["none"]["mean"] is None
    assert {r["column"]: r["outliers"] for r in cp.iqr_outliers(df).collect()} == {"a": 0, "none": 0}


def test_zero_rows(spark):
    profile = profile_table(spark.createDataFrame([], "a int, s string"))
    summary = profile.summary().first()
    assert (summary["rows"], summary["quality_score"], summary["duplicate_rows"]) == (0, 100, 0)
    assert {r["missing_percent"] for r in profile.columns.collect()} == {0.0}
    assert "0 rows and 2 columns" in summary["summary_text"]


def test_single_row(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert {r["std"] for r in cp.describe_numeric(df).collect()} == {None}
    assert {r["corr"] for r in correlation_matrix(df).collect()} == {0.0}


def test_complex_types_are_counted_only(spark):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1}), (2, None, {"a": 1}), (2, None, {"a": 1})],
                               "i int, arr array<int>, m map<string,int>")
    profile = by_column(cp.column_profile(df))
    assert (profile["arr"]["missing"], profile["arr"]["unique"]) == (2, None)
    assert duplicate_rows(df).first()[0] == 1


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (3, 5.0, "y")], "`a.b` int, `c``d` double, `e f` string")
    assert set(by_column(cp.column_profile(df))) == {"a.b", "c`d", "e f"}
    assert correlation_matrix(df).count() == 4
    assert duplicate_rows(df).first()[0] == 0


def test_wide_table(spark):
    df = spark.range(50).select(*[(F.col("id") * i % 17).cast("double").alias(f"c{i}") for i in range(1, 31)])
    profile, pdf = by_column(cp.column_profile(df)), df.toPandas()
    assert len(profile) == 30
    assert profile["c7"]["mean"] == pytest.approx(pdf["c7"].mean())
    found = {(r["x"], r["y"]): r["corr"] for r in correlation_matrix(df).collect()}
    expected = pdf.corr().fillna(0)
    assert len(found) == 900
    assert all(abs(found[x, y] - expected.loc[x, y]) < 0.00051 for x in pdf for y in pdf)


def test_correlation_uses_rows_with_both_values(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, None, 5), (3, 7, 5), (4, 1, 5)], "a int, b int, k int")
    found = {(r["x"], r["y"]): r["corr"] for r in correlation_matrix(df).collect()}
    assert found["a", "b"] == found["b", "a"] == 0.034
    assert found["a", "a"] == found["b", "b"] == 1.0
    assert all(found[p] == 0 for p in found if "k" in p)


def test_correlation_needs_two_numeric_columns(spark):
    assert correlation_matrix(spark.createDataFrame([(1, "a")], "a int, s string")).count() == 0


def test_duplicates_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (NAN, "a"), (NAN, "a"), (0.0, "z"), (-0.0, "z")], "x double, s string")
    assert duplicate_rows(df).first()[0] == 3
    assert duplicate_rows(df).first()[0] + df.distinct().count() == df.count()


@pytest.mark.parametrize("rows, missing, dups, outliers, score", [
    (10, 0, 0, 0, 100), (1, 3, 0, 0, 0), (0, 0, 0, 0, 100), (10, 1, 1, 1, 90), (3, 1, 1, 1, 67), (7, 2, 3, 1, 73)])
def test_quality_score(spark, rows, missing, dups, outliers, score):
    expected = max(100 - int(missing / max(rows, 1) * 40) - int(dups / max(rows, 1) * 30) - int(outliers / max(rows, 1) * 30), 0)
    got = spark.range(1).select(quality_score(F.lit(rows), F.lit(missing), F.lit(dups), F.lit(outliers))).first()[0]
    assert got == expected == score


def test_summary_text(spark):
    def text(*values):
        return spark.range(1).select(summary_text(*[F.lit(v).cast("bigint") for v in values])).first()[0]
    assert text(1234567, 3, 1152, 0, 2) == (
        "The dataset contains 1,234,567 rows and 3 columns. It occupies approximately 1.12 KB of memory. "
        "No missing values were detected. 2 duplicate rows were detected.")
    assert text(1, 1, 0, 4, 0).endswith("There are 4 missing values in the dataset. No duplicate rows were found.")


def test_group_profile_equals_profile_of_each_group(spark):
    rows = [(f"g{i % 3}", i % 7, float(i * i % 11) if i % 5 else None, "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, a int, b double, s string")
    grouped = profile_by_group(df, "g").long()
    for g in ("g0", "g1", "g2"):
        one = profile_table(df.where(F.col("g") == g).drop("g")).long()
        assert sorted(map(str, grouped.where(F.col("g") == g).drop("g").collect())) == sorted(map(str, one.collect()))


def test_group_with_a_missing_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    found = {r["g"]: r for r in group_scores(df, "g").collect()}
    assert set(found) == {None, "a"} and found[None]["rows"] == 2 and found[None]["duplicate_rows"] == 0


def test_stored_sections(spark):
    df = spark.createDataFrame([("x", 1, 2.0, "p"), ("x", 2, None, "p"), ("y", 3, 1.0, None)], "g string, a int, b double, s string")
    row = {r["g"]: r for r in profile_by_group(df, "g").analyses().collect()}["x"]
    assert row["summary"]["rows"] == 2 and row["duplicates"]["count"] == 0
    assert [c["name"] for c in row["column_info"]] == ["a", "b", "s"]
    assert row["missing_values"]["b"].asDict() == {"count": 1, "percent": 50.0}
    assert row["statistics"]["s"] == {"count": "2", "unique": "1", "top": "p", "freq": "2"}
    assert set(row["correlations"]) == {"a", "b"} and row["outliers"] == {"a": 0, "b": 0}


def test_sums_agree(mixed):
    profile = profile_table(mixed)
    assert profile.columns.agg(F.sum("missing")).first()[0] == profile.summary().first()["missing_cells"]
    matrix = {(r["x"], r["y"]): r["corr"] for r in profile.correlations.collect()}
    assert all(matrix[x, y] == matrix[y, x] and -1 <= matrix[x, y] <= 1 for x, y in matrix)


def test_outliers_do_not_depend_on_scale(spark):
    df = spark.range(200).select(((F.col("id") * 7919) % 101).cast("double").alias("v"),
                                 F.when(F.col("id") < 4, 1e6).otherwise(0).alias("shift"))
    v = df.select((F.col("v") + F.col("shift")).alias("v"))
    scaled = v.select((F.col("v") * 4 + 1024).alias("v"))
    assert cp.iqr_outliers(v).first()["outliers"] == cp.iqr_outliers(scaled).first()["outliers"] == 4
