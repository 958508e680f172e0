"""Report frames over profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from framegauge.functions import labels
from framegauge.operators import column_profile as cp
from framegauge.operators.correlation import correlation_matrix
from framegauge.operators.duplicates import duplicate_rows
from framegauge.plans import report
from workload import fixtures as fx
from workload.profile_queries import _corr_sql, _missing_sql, docs_bytes, _profile_long_sql, rounded, union


def _missing(spark, sf):
    return cp.column_missing(fx.docs_labeled(spark, sf))


def missing_long(spark, sf):
    """From the analyses' map of missing values alone: no other section is worked out."""
    return report.missing_long(cp.missing_values(fx.docs_labeled(spark, sf), ("lang",)), "lang")


def statistics_pivot(spark, sf):
    return rounded(report.statistics_pivot(cp.describe_all(fx.docs_labeled(spark, sf)), fx.DOCS_COLUMNS, "value"),
                   *fx.DOCS_COLUMNS)


def correlation_pivot(spark, sf):
    return report.correlation_pivot(correlation_matrix(fx.docs_labeled(spark, sf)), fx.DOCS_NUMBERS)


def strong_correlations(spark, sf):
    lines = fx.lineitem_gaps(spark, sf).withColumn("net", F.col("l_extendedprice") * (1 - F.coalesce("l_discount", F.lit(0.0)))) \
        .withColumn("left_over", -F.col("l_extendedprice")).select("l_quantity", "l_extendedprice", "l_tax", "net", "left_over")
    return report.strong_correlations(correlation_matrix(lines))


def size_label(spark, sf):
    size = F.col("file_size") * F.col("file_size")
    return fx.reg_datasets(spark, sf).select(
        "id", labels.size_label(size).alias("size"), labels.size_label(F.col("file_size"), 1, "MB").alias("short_size"),
        labels.kilobyte_label(F.col("file_size")).alias("kilobytes"))


def duplicate_advice(spark, sf):
    """Per type of event: do its users repeat?"""
    return duplicate_rows(fx.events_dup(spark, sf), ("event_type",)).withColumn(
        "advice", labels.duplicate_advice(F.col("duplicate_rows")))


def column_report(spark, sf):
    return report.column_report(cp.column_profile(fx.docs_labeled(spark, sf)))


def _fixed(value: str, digits: int) -> str:
    return f"round({value}, {digits})::DECIMAL(30, {digits})::VARCHAR"


_LONG = f"{fx.DOCS_LABELED}, p AS (\n" + _profile_long_sql("docs_labeled", docs_bytes(), fx.DOCS_NUMBERS, fx.DOCS_TEXTS) + ")"
_STRONG = ["l_quantity", "l_extendedprice", "l_tax", "net", "left_over"]

ENTRIES = {
    "missing_total": (lambda spark, sf: report.missing_total(_missing(spark, sf)), f"WITH {fx.DOCS_LABELED} SELECT "
        + " + ".join(f"count(*) - count({c})" for c in fx.DOCS_COLUMNS) + " AS missing_total FROM docs_labeled"),
    "missing_severity": (lambda spark, sf: report.missing_severity(_missing(spark, sf)),
        f"WITH {fx.DOCS_LABELED}, m AS ({_missing_sql('docs_labeled', fx.DOCS_COLUMNS)}) SELECT *, CASE WHEN missing_percent > 50 "
        "THEN 'high' WHEN missing_percent > 20 THEN 'medium' WHEN missing_percent > 0 THEN 'low' ELSE 'none' END AS severity FROM m"),
    "missing_long": (missing_long, f"WITH {fx.DOCS_LABELED}\n" + union(
        f"SELECT lang, '{c}' AS \"column\", count(*) - count({c}) AS missing FROM docs_labeled GROUP BY lang"
        for c in fx.DOCS_COLUMNS if c != "lang")),
    "dtype_histogram": (lambda spark, sf: report.dtype_histogram(fx.lineitem_gaps(spark, sf)),
        "SELECT CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float' WHEN 'TIMESTAMP' THEN 'datetime' "
        "ELSE 'integer' END AS kind, count(*) AS columns FROM (DESCRIBE lineitem) GROUP BY 1"),
    "quality_label": (lambda spark, sf: fx.reg_analyses(spark, sf).select(
        "dataset_id", "quality_score", labels.quality_label(F.col("quality_score")).alias("label")),
        f"WITH {fx.REG_ANALYSES} SELECT dataset_id, quality_score, CASE WHEN quality_score >= 80 THEN 'Excellent dataset quality' "
        "WHEN quality_score >= 50 THEN 'Dataset needs cleaning' ELSE 'Poor dataset quality' END AS label FROM reg_analyses"),
    "quality_band": (lambda spark, sf: fx.reg_analyses(spark, sf).select(
        "dataset_id", labels.quality_band(F.col("quality_score")).alias("band")),
        f"WITH {fx.REG_ANALYSES} SELECT dataset_id, CASE WHEN quality_score >= 90 THEN 'green' WHEN quality_score >= 70 THEN 'yellow' "
        "ELSE 'red' END AS band FROM reg_analyses"),
    "strong_correlations": (strong_correlations, f"""WITH {fx.LINEITEM_GAPS}, s AS (
  SELECT l_quantity, l_extendedprice, l_tax, l_extendedprice * (1 - coalesce(l_discount, 0)) AS net, -l_extendedprice AS left_over
  FROM lineitem_gaps), c AS (
{_corr_sql("s", _STRONG)})
SELECT x, y, {_fixed("corr", 2)} AS shown, CASE WHEN corr > 0.7 THEN 'positive' WHEN corr < -0.7 THEN 'negative' ELSE 'neutral' END
  AS strength FROM c WHERE x <> y"""),
    "statistics_pivot": (statistics_pivot, f"WITH {_LONG} SELECT metric, " + ", ".join(
        f"max(value) FILTER (WHERE name = '{c}') AS {c}" for c in fx.DOCS_COLUMNS)
        + " FROM p WHERE section = 'statistics' GROUP BY metric"),
    "correlation_pivot": (correlation_pivot, f"WITH {fx.DOCS_LABELED}, c AS ({_corr_sql('docs_labeled', fx.DOCS_NUMBERS)}) SELECT x, "
        + ", ".join(f"max(corr) FILTER (WHERE y = '{c}') AS {c}" for c in fx.DOCS_NUMBERS) + " FROM c GROUP BY x"),
    "column_report": (column_report, f"WITH {fx.DOCS_LABELED}\n" + union(
        f"SELECT '{c}' AS \"column\", '{'integer' if c in fx.DOCS_NUMBERS else 'string'}' AS dtype, "
        f"count(DISTINCT {c})::VARCHAR AS \"unique\", count(*) - count({c}) AS missing, "
        + (f"{_fixed(f'avg({c})', 2)} AS mean, {_fixed(f'stddev_samp({c})', 2)} AS std" if c in fx.DOCS_NUMBERS
           else "'-' AS mean, '-' AS std") + " FROM docs_labeled" for c in fx.DOCS_COLUMNS)),
    "size_label": (size_label, f"""WITH {fx.REG_DATASETS} SELECT id,
  CASE WHEN s < 1024 THEN s::VARCHAR || ' B' WHEN s < 1048576 THEN {_fixed("s / 1024.0::DOUBLE", 2)} || ' KB'
    WHEN s < 1073741824 THEN {_fixed("s / 1048576.0::DOUBLE", 2)} || ' MB' ELSE {_fixed("s / 1073741824.0::DOUBLE", 2)} || ' GB' END AS size,
  CASE WHEN file_size < 1024 THEN file_size::VARCHAR || ' B' WHEN file_size < 1048576 THEN {_fixed("file_size / 1024.0::DOUBLE", 1)} || ' KB'
    ELSE {_fixed("file_size / 1048576.0::DOUBLE", 1)} || ' MB' END AS short_size,
  {_fixed("file_size / 1024.0::DOUBLE", 2)} || ' KB' AS kilobytes
FROM (SELECT *, file_size * file_size AS s FROM reg_datasets)"""),
    "name_contains": (lambda spark, sf: fx.reg_datasets(spark, sf).where(
        labels.name_contains(F.col("original_filename"), "URGENT_1")).select("id", "original_filename"),
        f"WITH {fx.REG_DATASETS} SELECT id, original_filename FROM reg_datasets WHERE contains(lower(original_filename), 'urgent_1')"),
    "date_label": (lambda spark, sf: fx.reg_analyses(spark, sf).select(
        "dataset_id", labels.date_label(F.col("created_at")).alias("created")),
        f"WITH {fx.REG_ANALYSES} SELECT dataset_id, strftime(created_at, '%d %b %Y') AS created FROM reg_analyses"),
    "duplicate_advice": (duplicate_advice, """SELECT event_type, sum(n - 1)::BIGINT AS duplicate_rows,
  CASE WHEN sum(n - 1) = 0 THEN 'No duplicate rows found.' ELSE 'Dataset contains duplicate records that may require cleaning.' END
  AS advice FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type"""),
}
