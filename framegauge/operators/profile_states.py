"""Profiles as stored states that combine: of files, days or shards, in any order.

A column's state has its counts, mean, sum of squared deviations, bounds and a
HyperLogLog sketch of its values; a pair's has the means, squared deviations and
co-deviations of the rows that have both.  States of disjoint parts of a table give the
state of the whole, so a profile is refreshed from the new part's rows alone.  They are
plain rows, a few hundred bytes and a sketch each, and go to Parquet as they are.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.functions.columns import COMPLEX, NUMERIC_KINDS, kind_of, normalize_missing, quoted
from framegauge.operators.cells import key_names, keys_aliased
from framegauge.operators.column_profile import COLUMNS_PER_AGGREGATE, Keys, percent
from framegauge.operators.joins import null_safe_join
from framegauge.session import checkpointed

# Base-two logarithm of a sketch's registers; its standard error is about 0.83 / sqrt(2^LG).
SKETCH_LG = 12
# Column pairs of one aggregate.
PAIRS_PER_AGGREGATE = 28

COLUMN_MOMENTS = ("mean", "m2")
PAIR_MOMENTS = ("mean_x", "mean_y", "sxx", "syy", "sxy")


def unique_error(lg: int = SKETCH_LG) -> float:
    """Relative standard error of a distinct count from a sketch."""
    return 0.83 / 2 ** (lg / 2)


def _long(wide: DataFrame, keys: Keys, structs: list[Column]) -> DataFrame:
    return wide.select(*key_names(keys), F.inline(F.array(*structs))).withColumnsRenamed(dict(zip(key_names(keys), keys)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def column_states(df: DataFrame, keys: Keys = (), lg: int = SKETCH_LG) -> DataFrame:
    """(keys, column, rows, count, mean, m2, min, max, sketch), one row per group and column.

    Numbers have all of it, other scalar columns counts and a sketch, complex ones
    counts only.  One aggregate per twelve columns, combined before the shuffle.
    """
    clean = normalize_missing(df)
    names = [c for c in df.columns if c not in keys]
    parts = []
    for start in range(0, len(names), COLUMNS_PER_AGGREGATE):
        some = names[start:start + COLUMNS_PER_AGGREGATE]
        aggs, structs = [F.count(F.lit(1)).alias("rows")], []
        for i, c in enumerate(some):
            kind, value = kind_of(df.schema[c].dataType), quoted(c)
            number = value.cast("double") if kind in NUMERIC_KINDS else F.lit(None).cast("double")
            aggs += [F.count(value).alias(f"n{i}"), F.avg(number).alias(f"mean{i}"), F.var_pop(number).alias(f"var{i}"),
                     F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}")]
            if kind != COMPLEX:
                # Hashed, for sketches take neither doubles nor times; no values give an empty sketch.
                aggs.append(F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), lg).alias(f"sketch{i}"))
            structs.append(F.struct(
                F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("count"), F.col(f"mean{i}").alias("mean"),
                (F.col(f"var{i}") * F.col(f"n{i}")).alias("m2"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
                (F.lit(None).cast("binary") if kind == COMPLEX else F.col(f"sketch{i}")).alias("sketch")))
        picked = clean.select(*keys_aliased(keys), *[quoted(c) for c in some])
        parts.append(_long(picked.groupBy(*key_names(keys)).agg(*aggs), keys, structs))
    return _union(parts)


def pair_states(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, x, y, n, mean_x, mean_y, sxx, syy, sxy) for every pair of numeric columns, x with
    itself included, over the rows that have both values."""
    clean = normalize_missing(df)
    names = [f.name for f in df.schema if kind_of(f.dataType) in NUMERIC_KINDS and f.name not in keys]
    pairs = list(combinations_with_replacement(names, 2))
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_AGGREGATE):
        aggs, structs = [], []
        for i, (x, y) in enumerate(pairs[start:start + PAIRS_PER_AGGREGATE]):
            a, b = quoted(x).cast("double"), quoted(y).cast("double")
            found = {"n": F.regr_count(b, a), "mean_x": F.regr_avgx(b, a), "mean_y": F.regr_avgy(b, a),
                     "sxx": F.regr_sxx(b, a), "syy": F.regr_syy(b, a), "sxy": F.regr_sxy(b, a)}
            aggs += [value.alias(f"{name}{i}") for name, value in found.items()]
            structs.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), *[F.col(f"{name}{i}").alias(name) for name in found]))
        picked = clean.select(*keys_aliased(keys), *[quoted(c) for c in names])
        parts.append(_long(picked.groupBy(*key_names(keys)).agg(*aggs), keys, structs))
    if not parts:
        raise ValueError("no numeric columns")
    return _union(parts)


def _weighted(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def merge_column_states(states: DataFrame, keys: Keys = ()) -> DataFrame:
    """The states of disjoint parts put together; part and whole have the same columns.

    The means come first; squared deviations are then moved to the common mean, which
    loses no digits, as differences of large sums would.
    """
    states = checkpointed(states)
    by = [*keys, "column"]
    group = [quoted(c) for c in by]
    whole = checkpointed(states.groupBy(*group).agg(
        F.sum("rows").alias("rows"), F.sum("count").alias("count"), _weighted("mean", "count").alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.when(F.count("sketch") > 0, F.hll_union_agg("sketch")).alias("sketch")))
    apart = null_safe_join(states.select(*group, "count", F.col("mean").alias("own"), "m2"), whole.select(*group, "mean"), by, "left")
    moved = apart.groupBy(*group).agg(F.sum(F.col("m2") + F.col("count") * F.pow(F.col("own") - F.col("mean"), 2)).alias("m2"))
    return null_safe_join(whole, moved, by, "left").select(*group, "rows", "count", "mean", "m2", "min", "max", "sketch")


def merge_pair_states(states: DataFrame, keys: Keys = ()) -> DataFrame:
    """The states of disjoint parts put together; part and whole have the same columns."""
    states = checkpointed(states)
    by = [*keys, "x", "y"]
    group = [quoted(c) for c in by]
    whole = checkpointed(states.groupBy(*group).agg(
        F.sum("n").alias("n"), _weighted("mean_x", "n").alias("mean_x"), _weighted("mean_y", "n").alias("mean_y")))
    own = states.withColumnsRenamed({"mean_x": "own_x", "mean_y": "own_y"})
    apart = null_safe_join(own, whole.drop("n"), by, "left")
    dx, dy = F.col("own_x") - F.col("mean_x"), F.col("own_y") - F.col("mean_y")
    moved = apart.groupBy(*group).agg(*[F.sum(F.col(name) + F.col("n") * shift).alias(name) for name, shift in (
        ("sxx", dx * dx), ("syy", dy * dy), ("sxy", dx * dy))])
    return null_safe_join(whole, moved, by, "left").select(*group, "n", *PAIR_MOMENTS)


def profile_of_states(states: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, column, rows, missing, missing_percent, count, unique, mean, std, min, max).

    ``unique`` is an estimate with a standard error of ``unique_error()``; it is null for
    complex columns.
    """
    missing = F.col("rows") - F.col("count")
    unique = F.when(F.col("sketch").isNotNull(), F.hll_sketch_estimate("sketch"))
    return states.select(
        *[quoted(k) for k in keys], "column", "rows", missing.alias("missing"), percent(missing, F.col("rows")).alias("missing_percent"),
        "count", unique.alias("unique"), "mean", F.sqrt(F.try_divide(F.col("m2"), F.col("count") - 1)).alias("std"), "min", "max")


def correlations_of_states(states: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, x, y, corr) for every ordered pair, as ``correlation_matrix`` gives it."""
    corr = F.round(F.coalesce(F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))), F.lit(0.0)), 3)
    group = [quoted(k) for k in keys]
    one = states.select(*group, "x", "y", corr.alias("corr"))
    other = states.where("x <> y").select(*group, F.col("y").alias("x"), F.col("x").alias("y"), corr.alias("corr"))
    return one.unionByName(other)
