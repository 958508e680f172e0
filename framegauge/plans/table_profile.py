"""The whole profile of a table, or one profile per group of its rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.functions.columns import NUMERIC_KINDS, columns_of_kind, normalize_missing, quoted
from framegauge.operators.cells import key_names, keys_aliased, keys_restored, ordered_number
from framegauge.operators.column_profile import (
    column_counts, column_profile, iqr_outliers, metrics_long,
)
from framegauge.operators.correlation import correlation_matrix
from framegauge.operators.duplicates import duplicate_rows
from framegauge.operators.joins import null_safe_join
from framegauge.operators.quality import quality_score, summary_text
from framegauge.operators.quantiles import ARRAY_ROWS, TASK_ROWS, array_outliers
from framegauge.operators.row_groups import plain_types, row_group_counts
from framegauge.session import checkpointed

Keys = tuple[str, ...]


@dataclass
class Profile:
    """Sections of a profile; each frame starts with the group keys, if any."""

    keys: Keys
    columns: DataFrame
    correlations: DataFrame
    duplicates: DataFrame

    def summary(self) -> DataFrame:
        """Totals, score and text: one row per group."""
        on = [quoted(k) for k in self.keys]
        totals = self.columns.groupBy(*on).agg(
            F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
            F.sum("bytes").alias("memory_usage"), F.sum("missing").alias("missing_cells"),
            F.coalesce(F.sum("outliers"), F.lit(0)).alias("outlier_cells"))
        joined = (null_safe_join(totals, self.duplicates, list(self.keys), "left") if self.keys
                  else totals.withColumn("duplicate_rows", self.duplicates.select("duplicate_rows").scalar()))
        dups = F.coalesce("duplicate_rows", F.lit(0))
        return joined.select(
            *on, "rows", "columns", "memory_usage", "missing_cells", dups.alias("duplicate_rows"), "outlier_cells",
            quality_score(F.col("rows"), F.col("missing_cells"), dups, F.col("outlier_cells")).alias("quality_score"),
            summary_text(F.col("rows"), F.col("columns"), F.col("memory_usage"), F.col("missing_cells"), dups)
            .alias("summary_text"))

    def long(self) -> DataFrame:
        """All numbers of the profile as (section, name, metric, value, text)."""
        on = [quoted(k) for k in self.keys]
        none = F.lit(None).cast("string")

        def unfolded(frame: DataFrame, section: str, name, metrics: list[str]) -> DataFrame:
            return frame.select(*on, F.lit(section).alias("section"), name.alias("name"), F.inline(F.array(*[
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), none.alias("text"))
                for m in metrics])))

        statistics = metrics_long(self.columns, self.keys).select(
            *on, F.lit("statistics").alias("section"), F.col("column").alias("name"), "metric", "value",
            F.when(F.col("metric") == "top", F.col("text")).alias("text"))
        return (unfolded(self.summary(), "summary", F.lit("table"),
                         ["rows", "columns", "memory_usage", "missing_cells", "duplicate_rows"])
                .unionByName(unfolded(self.columns, "column_info", F.col("column"),
                                      ["missing", "missing_percent", "unique", "bytes"]))
                .unionByName(statistics)
                .unionByName(self.correlations.select(
                    *on, F.lit("correlations").alias("section"), F.col("x").alias("name"),
                    F.col("y").alias("metric"), F.col("corr").alias("value"), none.alias("text")))
                .unionByName(unfolded(self.columns.where(F.col("outliers").isNotNull()), "outliers",
                                      F.col("column"), ["outliers"])))

    def analyses(self) -> DataFrame:
        """One nested row per group, with the sections of a stored analysis.

        The collected lists have one entry per column, or per pair of columns.
        """
        on = [quoted(k) for k in self.keys]
        numeric = F.col("kind").isin("integer", "float", "decimal")
        info = self.columns.groupBy(*on).agg(
            F.sort_array(F.collect_list(F.struct("position", F.struct(
                F.col("column").alias("name"), F.col("kind").alias("dtype"), "missing", "missing_percent",
                "unique", F.col("bytes").alias("memory_usage")).alias("info")))).alias("column_info"),
            F.map_from_entries(F.collect_list(F.struct("column", F.struct(
                F.col("missing").alias("count"), F.col("missing_percent").alias("percent"))))).alias("missing_values"),
            F.map_from_entries(F.collect_list(F.when(numeric, F.struct("column", "outliers")))).alias("outliers"))
        info = info.withColumn("column_info", F.transform("column_info", lambda c: c["info"]))
        statistics = (metrics_long(self.columns, self.keys).where(F.col("text").isNotNull())
                      .groupBy(*on, "column")
                      .agg(F.map_from_entries(F.collect_list(F.struct("metric", "text"))).alias("metrics"))
                      .groupBy(*on)
                      .agg(F.map_from_entries(F.collect_list(F.struct("column", "metrics"))).alias("statistics")))
        correlations = (self.correlations.groupBy(*on, "x")
                        .agg(F.map_from_entries(F.collect_list(F.struct("y", "corr"))).alias("row"))
                        .groupBy(*on)
                        .agg(F.map_from_entries(F.collect_list(F.struct("x", "row"))).alias("correlations")))
        summary = self.summary().select(
            *on, F.struct("rows", "columns", "memory_usage", "missing_cells", "duplicate_rows").alias("summary"),
            F.struct(F.col("duplicate_rows").alias("count")).alias("duplicates"), "summary_text", "quality_score")
        result = summary
        for section in (info, statistics, correlations):
            result = null_safe_join(result, section, list(self.keys), "left")
        return result


def _profile(df: DataFrame, keys: Keys, task_rows: int) -> Profile:
    """Sections are read several times each; the scans of the table are done once.

    They have a row per column or pair of columns and are written to the shared
    folder, so a lost executor costs a re-read and not another profile.
    """
    columns = checkpointed(column_profile(df, keys, task_rows=task_rows))
    return Profile(keys, columns, checkpointed(correlation_matrix(df, keys, columns)), checkpointed(duplicate_rows(df, keys)))


def profile_table(df: DataFrame, task_rows: int = TASK_ROWS) -> Profile:
    return _profile(df, (), task_rows)


def profile_by_group(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> Profile:
    """One profile per value of the keys; the keys themselves are not profiled."""
    return _profile(df, keys, task_rows)


def group_scores(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS, latest: str | None = None) -> DataFrame:
    """Only what the quality score needs, per group, with the largest value of the date or time ``latest``.

    Where every group is small, rows are shuffled by group once and counted many groups
    at a time.  With columns that Arrow cannot tell apart as Spark does, one aggregate counts
    and brings the numbers together, and the outliers are taken from sorted arrays.
    """
    on = [quoted(k) for k in keys]
    plain = normalize_missing(df)
    short, limit = key_names(keys), min(task_rows, ARRAY_ROWS)
    newest = [quoted(latest)] if latest else []
    sizes = df.select(*keys_aliased(keys)).groupBy(*short).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= limit:
        if plain_types(df):
            return row_group_counts(plain, keys, latest).select(*on, "rows", "missing_cells", "duplicate_rows", "outlier_cells", quality_score(
                F.col("rows"), F.col("missing_cells"), F.col("duplicate_rows"), F.col("outlier_cells")).alias("quality_score"), *newest)
        numbers = columns_of_kind(plain, *NUMERIC_KINDS, skip=keys)
        others = [c for c in df.columns if c not in keys]
        gaps = sum((quoted(c).isNull().cast("int") for c in others), F.lit(0))
        wide = plain.select(*keys_aliased(keys), gaps.alias("gaps"),
                            *[ordered_number(plain, c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers)])
        arrays = wide.groupBy(*short).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("gaps").alias("missing_cells"),
            *[F.sort_array(F.collect_list(f"v{i}")).alias(f"v{i}") for i in range(len(numbers))])
        cells = sum((array_outliers(F.col(f"v{i}")) for i in range(len(numbers))), F.lit(0)).cast("bigint")
        counts = arrays.select(*keys_restored(keys), "rows", "missing_cells", cells.alias("outlier_cells"))
        joined = _with_latest(null_safe_join(counts, duplicate_rows(df, keys), list(keys), "left"), plain, keys, latest)
        return joined.select(*on, "rows", "missing_cells", "duplicate_rows", "outlier_cells", quality_score(
            F.col("rows"), F.col("missing_cells"), F.col("duplicate_rows"), F.col("outlier_cells")).alias("quality_score"), *newest)
    counts = column_counts(df, keys, moments=False).groupBy(*on).agg(
        F.max("rows").alias("rows"), F.sum("missing").alias("missing_cells"))
    outliers = iqr_outliers(df, keys, task_rows).groupBy(*on).agg(F.sum("outliers").alias("outlier_cells"))
    joined = null_safe_join(null_safe_join(counts, duplicate_rows(df, keys), list(keys), "left"),
                            outliers, list(keys), "left")
    joined = _with_latest(joined, plain, keys, latest)
    cells = F.coalesce("outlier_cells", F.lit(0))
    return joined.select(
        *on, "rows", "missing_cells", "duplicate_rows", cells.alias("outlier_cells"),
        quality_score(F.col("rows"), F.col("missing_cells"), F.col("duplicate_rows"), cells).alias("quality_score"), *newest)


def _with_latest(scores: DataFrame, df: DataFrame, keys: Keys, latest: str | None) -> DataFrame:
    if latest is None:
        return scores
    newest = df.groupBy(*[quoted(k) for k in keys]).agg(F.max(quoted(latest)).alias(latest))
    return null_safe_join(scores, newest, list(keys), "left")
