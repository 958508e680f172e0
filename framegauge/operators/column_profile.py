"""Per-column profile of a table or of every group of a table.

Three frames, each long with one row per (keys, column):

* ``column_counts``: rows, missing, bytes, mean, std, min, max.  One aggregate per
  batch of columns; a batch scans only its own columns.
* ``order_profile``: unique, quartiles, fences and outliers of ordered columns.
* ``category_profile``: unique, top and freq of strings and booleans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.columns import (
    BOOLEAN, CATEGORICAL_KINDS, COMPLEX, DATETIME, NUMERIC_KINDS, STRING,
    columns_of_kind, fixed_width, from_micros, kind_of, micros, normalize_missing, quoted, text_bytes,
)
from framegauge.operators.cells import (
    distinct_counts, is_wide_decimal, key_names, keys_aliased, keys_restored, name_at, number_cells,
    text_cells, value_counts,
)
from framegauge.operators.joins import null_safe_join
from framegauge.operators.quantiles import (
    QUARTILES, TASK_ROWS, fences, group_order_statistics, table_order_statistics,
)

# One aggregate keeps at most this many columns, to stay within code generation.
COLUMNS_PER_AGGREGATE = 12

# Columns of a profile that come from the values themselves.
VALUE_COLUMNS = {
    "unique": "bigint", "q25": "double", "q50": "double", "q75": "double", "lower": "double",
    "upper": "double", "outliers": "bigint", "top": "string", "freq": "bigint",
}

# Those of ``column_counts``, in order.
COUNT_COLUMNS = {
    "rows": "bigint", "position": "int", "column": "string", "kind": "string", "count": "bigint", "missing": "bigint",
    "bytes": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double", "missing_percent": "double",
}

Keys = tuple[str, ...]


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, 2), F.lit(0.0))


def _profiled(df: DataFrame, keys: Keys) -> list[str]:
    return [c for c in df.columns if c not in keys]


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("columns"))


def _defined(name: str) -> Column:
    """A moment, null where infinities leave it undefined."""
    return F.when(~F.isnan(name), F.col(name))


def _empty(df: DataFrame, keys: Keys, columns: dict[str, str]) -> DataFrame:
    """No rows of (keys, column, ...), for a table without a column of the kind."""
    schema = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in ({"column": "string"} | columns).items())).fields])
    return df.sparkSession.createDataFrame([], schema)


def _count_struct(df: DataFrame, name: str, position: int, moments: bool) -> tuple[list[Column], Column]:
    """Aggregates of one column and the struct that turns them into a row."""
    dtype = df.schema[name].dataType
    kind, col, p = kind_of(dtype), quoted(name), f"c{position}"
    size = text_bytes(col, dtype)
    aggs = [F.count(col).alias(f"{p}_count")]
    if size is not None:
        aggs.append(F.coalesce(F.sum(size), F.lit(0)).alias(f"{p}_bytes"))
        stored = F.col(f"{p}_bytes")
    else:
        stored = F.col(f"{p}_count") * F.lit(fixed_width(dtype))
    none = F.lit(None).cast("double")
    mean, std, low, high = none, none, none, none
    if moments and kind in NUMERIC_KINDS + (DATETIME,):
        number = micros(col) if kind == DATETIME else col
        aggs += [F.avg(number.cast("double")).alias(f"{p}_mean"),
                 F.min(number).cast("double").alias(f"{p}_min"),
                 F.max(number).cast("double").alias(f"{p}_max")]
        mean, low, high = _defined(f"{p}_mean"), F.col(f"{p}_min"), F.col(f"{p}_max")
        if kind in NUMERIC_KINDS:
            aggs.append(F.stddev_samp(number.cast("double")).alias(f"{p}_std"))
            std = _defined(f"{p}_std")
    row = F.struct(
        F.lit(position).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("kind"),
        F.col(f"{p}_count").alias("count"), (F.col("rows") - F.col(f"{p}_count")).alias("missing"),
        stored.cast("bigint").alias("bytes"),
        mean.alias("mean"), std.alias("std"), low.alias("min"), high.alias("max"))
    return aggs, row


def column_counts(df: DataFrame, keys: Keys = (), moments: bool = True) -> DataFrame:
    """One row per column: rows, count, missing, bytes, mean, std, min, max."""
    df = normalize_missing(df)
    names = _profiled(df, keys)
    parts = []
    for start in range(0, max(len(names), 1), COLUMNS_PER_AGGREGATE):
        aggs, rows = [F.count(F.lit(1)).alias("rows")], []
        for position, name in list(enumerate(names))[start:start + COLUMNS_PER_AGGREGATE]:
            more, row = _count_struct(df, name, position, moments)
            aggs += more
            rows.append(row)
        grouped = df.select(*keys_aliased(keys), *[quoted(c) for c in names]) \
            .groupBy(*key_names(keys)).agg(*aggs)
        if rows:
            parts.append(grouped.select(*keys_restored(keys), "rows", F.inline(F.array(*rows))))
    if not parts:
        return _empty(df, keys, COUNT_COLUMNS).select(*[quoted(k) for k in keys], *COUNT_COLUMNS)
    return reduce(DataFrame.unionByName, parts).withColumn(
        "missing_percent", percent(F.col("missing"), F.col("rows")))


def missing_cells(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Missing cells over all columns."""
    counts = column_counts(df, keys, moments=False)
    return counts.groupBy(*[quoted(k) for k in keys]).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"))


def column_missing(df: DataFrame, keys: Keys = ()) -> DataFrame:
    return column_counts(df, keys, moments=False).select(
        *[quoted(k) for k in keys], "column", "missing", "missing_percent")


def missing_values(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, missing_values): the map from column to count and percent that analyses store,
    from one counting pass."""
    entry = F.struct(F.col("missing").alias("count"), F.col("missing_percent").alias("percent"))
    return column_missing(df, keys).groupBy(*[quoted(k) for k in keys]).agg(
        F.map_from_entries(F.collect_list(F.struct("column", entry))).alias("missing_values"))


def estimated_bytes(df: DataFrame) -> DataFrame:
    """Per column: fixed width times present values, or the bytes of the texts."""
    return column_counts(df, moments=False).select("column", "bytes")


def total_bytes(df: DataFrame) -> DataFrame:
    return estimated_bytes(df).agg(F.sum("bytes").alias("bytes"))


def order_profile(
    df: DataFrame,
    keys: Keys = (),
    kinds: tuple[str, ...] = NUMERIC_KINDS + (DATETIME,),
    task_rows: int = TASK_ROWS,
    outliers: bool = True,
    unique: bool = True,
) -> DataFrame:
    """One row per ordered column with a value: quartiles, fences, outliers, unique."""
    df = normalize_missing(df)
    columns = columns_of_kind(df, *kinds, skip=keys)
    if not columns:
        return _empty(df, keys, {c: t for c, t in VALUE_COLUMNS.items() if c not in ("top", "freq")})
    if keys:
        stats = group_order_statistics(df, columns, keys, task_rows)
    else:
        stats = table_order_statistics(df, columns, task_rows, outliers, unique)
    lower, upper = fences(F.col("q25"), F.col("q75"))
    found = [c for c in ("outliers", "unique") if c in stats.columns]
    return stats.select(*keys_restored(keys), name_at(columns).alias("column"),
                        *QUARTILES, lower.alias("lower"), upper.alias("upper"), *found)


def category_profile(df: DataFrame, keys: Keys = (), kinds: tuple[str, ...] = CATEGORICAL_KINDS) -> DataFrame:
    """One row per text-like column with a value: unique, top, freq.

    The most frequent value is ``top``; of equally frequent ones the smallest.
    """
    columns = columns_of_kind(df, *kinds, skip=keys)
    if not columns:
        return _empty(df, keys, {c: VALUE_COLUMNS[c] for c in ("unique", "top", "freq")})
    group = key_names(keys) + ["idx"]
    counts = value_counts(text_cells(df, columns, keys), group)
    # The smallest struct has the largest count and, among equals, the smallest text.
    best = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    return (counts.groupBy(*group).agg(F.count(F.lit(1)).alias("unique"), best.alias("best"))
            .select(*keys_restored(keys), name_at(columns).alias("column"), "unique",
                    F.col("best.value").alias("top"), (-F.col("best.n")).alias("freq")))


def _unique_of(df: DataFrame, numbers: list[str], texts: list[str], keys: Keys) -> DataFrame | None:
    group, parts = key_names(keys) + ["idx"], []
    for names, cells in ((numbers, number_cells), (texts, text_cells)):
        if names:
            frames = cells(df, names, keys)
            counts = distinct_counts(frames if isinstance(frames, list) else [frames], group)
            parts.append(counts.select(*keys_restored(keys), name_at(names).alias("column"), "unique"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def column_profile(
    df: DataFrame,
    keys: Keys = (),
    task_rows: int = TASK_ROWS,
    outliers: bool = True,
    unique: bool = True,
) -> DataFrame:
    """Everything about each column in one row per (keys, column).

    Without ``outliers`` or ``unique`` a table's numeric columns are spared those
    passes and have 0 there.
    """
    on = list(keys) + ["column"]
    profile = column_counts(df, keys)
    ordered = order_profile(df, keys, task_rows=task_rows, outliers=outliers, unique=unique)
    texts = category_profile(df, keys)
    profile = null_safe_join(profile, ordered.unionByName(texts, allowMissingColumns=True), on, "left")
    for name, dtype in VALUE_COLUMNS.items():
        if name not in profile.columns:
            profile = profile.withColumn(name, F.lit(None).cast(dtype))
    # Decimals that a double cannot tell apart are counted by their text.
    wide = [f.name for f in df.schema if f.name not in keys and is_wide_decimal(f.dataType)]
    exact = _unique_of(df, [], wide, keys)
    if exact is not None:
        profile = null_safe_join(
            profile, exact.withColumnRenamed("unique", "exact_unique"), on, "left"
        ).withColumn("unique", F.coalesce("exact_unique", "unique")).drop("exact_unique")
    numeric = F.col("kind").isin(*NUMERIC_KINDS)
    counted = F.col("kind") != COMPLEX
    return (profile
            .withColumn("unique", F.when(counted, F.coalesce("unique", F.lit(0))))
            .withColumn("lower", F.when(numeric, F.col("lower")))
            .withColumn("upper", F.when(numeric, F.col("upper")))
            .withColumn("outliers", F.when(numeric, F.coalesce("outliers", F.lit(0)))))


def column_unique(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Distinct non-missing values of every scalar column, exactly."""
    df = normalize_missing(df)
    numbers = [c for c in columns_of_kind(df, *NUMERIC_KINDS, DATETIME, skip=keys)
               if not is_wide_decimal(df.schema[c].dataType)]
    texts = [f.name for f in df.schema if f.name not in keys
             and (kind_of(f.dataType) in CATEGORICAL_KINDS or is_wide_decimal(f.dataType))]
    found = _unique_of(df, numbers, texts, keys)
    return _empty(df, keys, {"unique": "bigint"}) if found is None else found


def column_unique_estimate(df: DataFrame, relative_error: float = 0.05) -> DataFrame:
    """Distinct values of every scalar column by sketch: one scan, no data shuffle."""
    df = normalize_missing(df)
    names = [f.name for f in df.schema if kind_of(f.dataType) != COMPLEX]
    wide = df.agg(*[F.approx_count_distinct(quoted(c), relative_error).alias(f"u{i}")
                    for i, c in enumerate(names)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("unique")) for i, c in enumerate(names)])))


def describe_numeric(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column."""
    picked = df.select(*[quoted(c) for c in columns_of_kind(df, *NUMERIC_KINDS)])
    ordered = order_profile(picked, task_rows=task_rows, outliers=False, unique=False)
    return null_safe_join(column_counts(picked), ordered, ["column"], "left").select(
        "column", "count", "mean", "std", "min", *QUARTILES, "max")


def describe_categorical(df: DataFrame) -> DataFrame:
    """count, unique, top and freq of every string and boolean column."""
    picked = df.select(*[quoted(c) for c in columns_of_kind(df, *CATEGORICAL_KINDS)])
    counts = column_counts(picked, moments=False).select("column", "count")
    return null_safe_join(counts, category_profile(picked), ["column"], "left").select(
        "column", "count", F.coalesce("unique", F.lit(0)).alias("unique"), "top", "freq")


def describe_temporal(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """count, mean, min, quartiles and max of every date or timestamp column."""
    picked = df.select(*[quoted(c) for c in columns_of_kind(df, DATETIME)])
    ordered = order_profile(picked, kinds=(DATETIME,), task_rows=task_rows, outliers=False, unique=False)
    return null_safe_join(column_counts(picked), ordered, ["column"], "left").select(
        "column", "count", *[from_micros(F.col(c)).alias(c) for c in ("mean", "min", *QUARTILES, "max")])


# Metrics of a mixed table in report order, with the column that holds each.
METRICS = {
    "count": "count", "unique": "unique", "top": "top", "freq": "freq", "mean": "mean", "std": "std",
    "min": "min", "25%": "q25", "50%": "q50", "75%": "q75", "max": "max",
}


def metrics_long(profile: DataFrame, keys: Keys = ()) -> DataFrame:
    """A column profile as (column, metric, value, text).

    ``value`` holds numbers, ``text`` holds every metric as text; a metric that
    does not apply to a column has neither.
    """
    temporal, numeric = F.col("kind") == DATETIME, F.col("kind").isin(*NUMERIC_KINDS)
    textual = F.col("kind").isin(STRING, BOOLEAN)
    rows = []
    for order, (metric, source) in enumerate(METRICS.items()):
        none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
        if metric == "count":
            value, text = F.col("count").cast("double"), F.col("count").cast("string")
        elif metric in ("unique", "freq"):
            value = F.when(textual, F.col(source).cast("double")).otherwise(none_d)
            text = F.when(textual, F.col(source).cast("string")).otherwise(none_s)
        elif metric == "top":
            value, text = none_d, F.when(textual, F.col("top"))
        else:
            value = F.when(numeric, F.col(source))
            iso = F.date_format(from_micros(F.col(source)), "yyyy-MM-dd'T'HH:mm:ss")
            text = F.when(numeric, F.col(source).cast("string")).when(temporal, iso)
        rows.append(F.struct(F.lit(order).alias("metric_order"), F.lit(metric).alias("metric"),
                             value.alias("value"), text.alias("text")))
    return profile.select(*[quoted(k) for k in keys], "position", "column", F.inline(F.array(*rows)))


def describe_all(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every metric of every column, inapplicable ones null."""
    return metrics_long(column_profile(df, task_rows=task_rows, outliers=False, unique=False))


def _iqr(df: DataFrame, keys: Keys, task_rows: int, outliers: bool) -> DataFrame:
    """Quartiles, fences and outliers per numeric column that has a value."""
    return order_profile(df, keys, NUMERIC_KINDS, task_rows, outliers=outliers, unique=False)


def iqr_quartiles(df: DataFrame, keys: Keys = (), task_rows: int = TASK_ROWS) -> DataFrame:
    return _iqr(df, keys, task_rows, False).select(*[quoted(k) for k in keys], "column", "q25", "q75")


def iqr_fences(df: DataFrame, keys: Keys = (), task_rows: int = TASK_ROWS) -> DataFrame:
    return _iqr(df, keys, task_rows, False).select(
        *[quoted(k) for k in keys], "column", (F.col("q75") - F.col("q25")).alias("iqr"), "lower", "upper")


def iqr_outliers(df: DataFrame, keys: Keys = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows strictly outside the fences, 0 for a column without values in a table."""
    found = _iqr(df, keys, task_rows, True).select(*[quoted(k) for k in keys], "column", "outliers")
    if keys:
        return found
    names = columns_of_kind(df, *NUMERIC_KINDS)
    every = df.sparkSession.createDataFrame([(c,) for c in names], T.StructType([T.StructField("column", T.StringType())]))
    return every.join(found, "column", "left").select("column", F.coalesce("outliers", F.lit(0)).alias("outliers"))


def outlier_rows(df: DataFrame, column: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of ``df`` whose ``column`` lies outside its fences.

    The two fences reach the filter as scalar subqueries.
    """
    fence = iqr_fences(df.select(quoted(column)), task_rows=task_rows)
    lower, upper = fence.select("lower").scalar(), fence.select("upper").scalar()
    return normalize_missing(df).where((quoted(column) < lower) | (quoted(column) > upper))
