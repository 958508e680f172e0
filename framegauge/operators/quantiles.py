"""Exact quartiles and IQR outliers for many columns at once.

A group of many rows never goes through one task.  Its ranks are first located
in a histogram whose size is fixed by construction (logarithmic buckets); the
buckets holding them are split again until the rows left around each rank fit
one task, and only those are ordered.  Every pass is a scan with map-side
combining, so only bucket counts are shuffled.  Usually two passes do.

Groups known to be small bring their values together in one shuffle by key and
are solved from sorted arrays of a bounded length.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framegauge.operators.cells import (
    distinct_counts, key_names, keys_aliased, number_cells, ordered_number, real_cells,
    unpivoted, value_counts,
)
from framegauge.operators.joins import BROADCAST_ROWS, count_up_to, keyed_join
from framegauge.session import checkpointed

PROBS = (0.25, 0.5, 0.75)
QUARTILES = ("q25", "q50", "q75")
# The six ranks behind the three quartiles, in ascending order.
RANKS = tuple((q, p, side) for q, p in zip(QUARTILES, PROBS) for side in (F.floor, F.ceil))
FENCE_FACTOR = 1.5
# Rows around a rank that one task may order.
TASK_ROWS = 250_000
# Rows of a group whose values may be brought together in one array.
ARRAY_ROWS = 50_000

# Buckets per e-fold of the first histogram; the whole double range then has
# fewer than 200,000 buckets, a column in use a few hundred.
LOG_RESOLUTION = 64
LOG_OFFSET = 746.0
LOG_INFINITY = 100_000
# Pieces that a chosen bucket is split into on each further pass.
SPLITS = 4096


def interpolate(low: Column, high: Column, weight: Column) -> Column:
    """Linear interpolation, taken from the nearer end."""
    step = high - low
    return (F.when(low == high, low)
            .when(weight < 0.5, low + step * weight)
            .otherwise(high - step * (1 - weight)))


def fences(q1: Column, q3: Column) -> tuple[Column, Column]:
    spread = q3 - q1
    return q1 - spread * FENCE_FACTOR, q3 + spread * FENCE_FACTOR


def _position(total: Column, prob: float) -> Column:
    """Zero-based position of a quantile among ``total`` ordered values."""
    return (total - 1) * F.lit(prob)


def _weight(total: Column, prob: float) -> Column:
    return _position(total, prob) - F.floor(_position(total, prob))


def _running(order: list[str], *group: str):
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def _outside(lower: Column, upper: Column, value: Column) -> Column:
    return (value < lower) | (value > upper)


# --- ranges that hold a rank -------------------------------------------------
#
# A range is a row (group, lo, hi, n, before, total): n of the group's total
# values lie in [lo, hi] and before of them below.  A group has one to six of
# them, disjoint, together holding every rank asked for.

def _log_bucket(v: Column) -> Column:
    """Non-decreasing in ``v``: the sign times the scaled logarithm."""
    size = F.when(F.abs(v) == float("inf"), F.lit(LOG_INFINITY)).otherwise(
        1 + F.floor((F.ln(F.abs(v)) + LOG_OFFSET) * LOG_RESOLUTION).cast("int"))
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _bucket_sizes() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")]


def _holding_ranks(buckets: DataFrame, group: list[str]) -> DataFrame:
    """The buckets that hold one of the ranks of their group."""
    held = F.lit(False)
    for _, p, side in RANKS:
        rank = side(_position(F.col("total"), p))
        held = held | ((F.col("before") <= rank) & (F.col("before") + F.col("n") > rank))
    return buckets.where(held).select(*group, "lo", "hi", "n", "before", "total")


def _first_ranges(cells: DataFrame, group: list[str]) -> DataFrame:
    """Ranges from a histogram with logarithmic buckets."""
    part = Window.partitionBy(*group)
    buckets = cells.groupBy(*group, _log_bucket(F.col("value")).alias("bucket")).agg(*_bucket_sizes())
    return _holding_ranks(
        buckets.withColumn("before", F.sum("n").over(_running(["bucket"], *group)) - F.col("n"))
        .withColumn("total", F.sum("n").over(part)), group)


def _inside(cells: DataFrame, ranges: DataFrame, group: list[str], rows: int) -> DataFrame:
    """Cells in the ranges of more than one value, with their range."""
    open_ranges = ranges.where(F.col("lo") < F.col("hi")).withColumnRenamed("n", "range_rows")
    return keyed_join(cells, open_ranges, group, "inner", rows).where(
        F.col("value").between(F.col("lo"), F.col("hi")))


def _narrower_ranges(cells: DataFrame, ranges: DataFrame, group: list[str], rows: int) -> DataFrame:
    """Split the open ranges and keep the pieces that hold a rank.

    The smallest and the largest value of a range land in different pieces, so
    every pass makes each open range strictly smaller.
    """
    share = F.when(F.col("value") == F.col("lo"), 0.0).otherwise(
        (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    piece = F.least(F.floor(share * SPLITS), F.lit(SPLITS - 1)).cast("int")
    key = [*group, "start", "total"]
    pieces = (_inside(cells, ranges, group, rows)
              .select(*group, F.col("before").alias("start"), "total", "value", piece.alias("piece"))
              .groupBy(*key, "piece").agg(*_bucket_sizes())
              .withColumn("before", F.col("start") + F.sum("n").over(_running(["piece"], *key)) - F.col("n")))
    return _holding_ranks(pieces, group).unionByName(ranges.where(F.col("lo") == F.col("hi")))


def _solve(ranges: DataFrame, near: DataFrame, group: list[str]) -> DataFrame:
    """Quartiles from the ranges; ``near`` counts the values inside the open ones."""
    key = [*group, "start", "total"]
    counted = near.withColumn("before", F.col("start") + F.sum("n").over(_running(["value"], *key)) - F.col("n"))
    known = ranges.where(F.col("lo") == F.col("hi")).withColumnRenamed("lo", "value")
    placed = counted.select(*group, "total", "value", "n", "before").unionByName(
        known.select(*group, "total", "value", "n", "before"))
    ends = [F.min(F.when(F.col("before") + F.col("n") > side(_position(F.col("total"), p)), F.col("value"))).alias(f"v{i}")
            for i, (_, p, side) in enumerate(RANKS)]
    return placed.groupBy(*group).agg(F.max("total").alias("total"), *ends).select(*group, *[
        interpolate(F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}"), _weight(F.col("total"), p)).alias(q)
        for i, (q, p) in enumerate(zip(QUARTILES, PROBS))])


def _near_counts(inside: DataFrame, group: list[str]) -> DataFrame:
    return inside.groupBy(*group, F.col("before").alias("start"), "total", "value").agg(F.count(F.lit(1)).alias("n"))


# --- the whole table: one group per column -----------------------------------

def _small_frame(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A few rows per column of a table, as a local relation."""
    table = pa.Table.from_pylist([r.asDict() for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table)


def table_quartiles(df: DataFrame, columns: list[str], task_rows: int = TASK_ROWS) -> list:
    """Rows (idx, q25, q50, q75), one per column that has a value."""
    spark, cells, group = df.sparkSession, real_cells(df, columns), ["idx"]
    first = _first_ranges(cells, group)
    schema, rows = first.schema, first.collect()
    while any(r["lo"] < r["hi"] and r["n"] > task_rows for r in rows):
        rows = _narrower_ranges(cells, _small_frame(spark, rows, schema), group, len(rows)).collect()
    if not rows:
        return []
    # Values outside the open ranges turn null here and are dropped by the unpivot.
    values = {}
    for r in rows:
        if r["lo"] < r["hi"]:
            value = ordered_number(df, columns[r["idx"]]).cast("double")
            hit = F.when(value.between(F.lit(r["lo"]), F.lit(r["hi"])), value)
            values[r["idx"]] = F.coalesce(values[r["idx"]], hit) if r["idx"] in values else hit
    ranges = _small_frame(spark, rows, schema)
    near = _near_counts(_inside(unpivoted(df, (), values) if values else cells.limit(0), ranges, group, len(rows)), group)
    return _solve(ranges, near, group).collect()


def table_outliers(df: DataFrame, columns: list[str], quartiles: list) -> DataFrame:
    """(idx, outliers): one scan against the columns' fences, without a shuffle of rows."""
    counts, rows = [], []
    for r in quartiles:
        lower, upper = fences(F.lit(r["q25"]), F.lit(r["q75"]))
        value = ordered_number(df, columns[r["idx"]]).cast("double")
        counts.append(F.count_if(_outside(lower, upper, value)).alias(f"o{r['idx']}"))
        rows.append(F.struct(F.lit(r["idx"]).alias("idx"), F.col(f"o{r['idx']}").alias("outliers")))
    return df.agg(*counts).select(F.inline(F.array(*rows)))


QUARTILE_SCHEMA = T.StructType([T.StructField("idx", T.IntegerType())]
                               + [T.StructField(q, T.DoubleType()) for q in QUARTILES])


def table_order_statistics(
    df: DataFrame, columns: list[str], task_rows: int, outliers: bool, unique: bool,
) -> DataFrame:
    """(idx, quartiles, outliers?, unique?) over the whole table."""
    quartiles = table_quartiles(df, columns, task_rows)
    stats = _small_frame(df.sparkSession, quartiles, QUARTILE_SCHEMA)
    if outliers:
        stats = stats.join(table_outliers(df, columns, quartiles), "idx", "left") if quartiles else \
            stats.withColumn("outliers", F.lit(0).cast("bigint"))
    if unique:
        stats = stats.join(distinct_counts(number_cells(df, columns), ["idx"]), "idx", "left")
    return stats


# --- groups of a table -------------------------------------------------------

def array_outliers(values: Column) -> Column:
    """Values of one sorted array outside its own fences."""
    def count(low: Column, high: Column) -> Column:
        lower, upper = fences(low, high)
        return F.size(F.filter(values, lambda v: _outside(lower, upper, v)))

    def quartile(prob: float) -> Column:
        total = F.size(values)
        at = [F.get(values, side(_position(total, prob)).cast("int")) for side in (F.floor, F.ceil)]
        return interpolate(*at, _weight(total, prob))

    both = F.array(F.struct(quartile(0.25).alias("low"), quartile(0.75).alias("high")))
    return F.coalesce(F.element_at(F.transform(both, lambda q: count(q["low"], q["high"])), 1), F.lit(0))


def _array_groups(df: DataFrame, columns: list[str], short: list[str]) -> DataFrame:
    """Order statistics of groups of a bounded size, from one sorted array per column."""
    arrays = df.groupBy(*short).agg(*[F.sort_array(F.collect_list(f"v{i}")).alias(f"v{i}") for i in range(len(columns))])
    cells = arrays.select(*short, F.inline(F.array(*[
        F.struct(F.lit(i).alias("idx"), F.size(F.array_distinct(f"v{i}")).cast("bigint").alias("unique"),
                 F.col(f"v{i}").cast("array<double>").alias("values")) for i in range(len(columns))])))
    cells = cells.where(F.size("values") > 0).withColumn("total", F.size("values"))
    for i, (_, p, side) in enumerate(RANKS):
        cells = cells.withColumn(f"v{i}", F.get("values", side(_position(F.col("total"), p)).cast("int")))
    for i, (q, p) in enumerate(zip(QUARTILES, PROBS)):
        cells = cells.withColumn(q, interpolate(F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}"), _weight(F.col("total"), p)))
    lower, upper = fences(F.col("q25"), F.col("q75"))
    outside = F.filter("values", lambda v: _outside(F.col("lower"), F.col("upper"), v))
    return (cells.withColumn("lower", lower).withColumn("upper", upper)
            .select(*short, "idx", "unique", *QUARTILES, F.size(outside).cast("bigint").alias("outliers")))


def large_group_quartiles(cells: DataFrame, group: list[str], task_rows: int) -> tuple[DataFrame, int]:
    """Exact quartiles of groups of any size, and a bound on their number."""
    ranges = checkpointed(_first_ranges(cells, group))
    rows = count_up_to(ranges, BROADCAST_ROWS)
    too_large = (F.col("lo") < F.col("hi")) & (F.col("n") > task_rows)
    while not ranges.where(too_large).isEmpty():
        ranges = checkpointed(_narrower_ranges(cells, ranges, group, rows))
        rows = count_up_to(ranges, BROADCAST_ROWS)
    near = _near_counts(_inside(cells, ranges, group, rows), group)
    return checkpointed(_solve(ranges, near, group)), rows


def _large_groups(df: DataFrame, columns: list[str], keys: tuple[str, ...], large: DataFrame, groups: int,
                  task_rows: int) -> list[DataFrame]:
    short = key_names(keys)
    group, parts = [*short, "idx"], []
    for cells in number_cells(df, columns, keys):
        inside = keyed_join(cells, large, short, "left_semi", groups)
        quartiles, rows = large_group_quartiles(
            inside.withColumn("value", F.col("value").cast("double")), group, task_rows)
        counts = value_counts(inside, group).withColumn("v", F.col("value").cast("double"))
        located = keyed_join(counts, quartiles, group, "inner", rows)
        outside = _outside(*fences(F.col("q25"), F.col("q75")), F.col("v"))
        parts.append(located.groupBy(*group, *QUARTILES).agg(
            F.count(F.lit(1)).alias("unique"),
            F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outliers"))
            .select(*group, "unique", *QUARTILES, "outliers"))
    return parts


def group_order_statistics(
    df: DataFrame, columns: list[str], keys: tuple[str, ...], task_rows: int,
) -> DataFrame:
    """(keys, idx, unique, quartiles, outliers) per group of rows."""
    short = key_names(keys)
    limit = min(task_rows, ARRAY_ROWS)
    large = checkpointed(
        df.select(*keys_aliased(keys)).groupBy(*short).agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > limit).select(*short))
    groups = count_up_to(large, BROADCAST_ROWS)
    wide = df.select(*keys_aliased(keys), *[ordered_number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    if groups == 0:
        return _array_groups(wide, columns, short)
    small = keyed_join(wide, large, short, "left_anti", groups)
    return reduce(DataFrame.unionByName, [
        _array_groups(small, columns, short), *_large_groups(df, columns, keys, large, groups, task_rows)])
