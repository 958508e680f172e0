"""Tables as long frames of cells, the common input of the column operators.

A cell frame has the key columns under safe names ``k0, k1, ...``, the position
``idx`` of the column in a chosen list, and its ``value``.  UNPIVOT compiles to
one generated Expand, with missing cells dropped.  Whole and real numbers are
kept in frames of their own, each with a two-column grouping key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.columns import DATETIME, DECIMAL, FLOAT, INTEGER, kind_of, micros, quoted

# Decimal digits that a double always tells apart.
DOUBLE_DIGITS = 15


def key_names(keys: tuple[str, ...]) -> list[str]:
    return [f"k{i}" for i in range(len(keys))]


def keys_aliased(keys: tuple[str, ...]) -> list[Column]:
    return [quoted(k).alias(s) for k, s in zip(keys, key_names(keys))]


def keys_restored(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(s).alias(k) for k, s in zip(keys, key_names(keys))]


def name_at(columns: list[str], idx: str = "idx") -> Column:
    """Column name for a position in ``columns``."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(idx) + 1)


def is_wide_decimal(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.DecimalType) and dtype.precision > DOUBLE_DIGITS


def ordered_number(df: DataFrame, name: str) -> Column:
    """A numeric or temporal column as bigint or double."""
    kind, col = kind_of(df.schema[name].dataType), quoted(name)
    if kind == DATETIME:
        return micros(col)
    return col.cast("bigint" if kind == INTEGER else "double")


def unpivoted(df: DataFrame, keys: tuple[str, ...], values: dict[int, Column]) -> DataFrame:
    wide = df.select(*keys_aliased(keys), *[v.alias(f"v{i}") for i, v in values.items()])
    picks = ", ".join(f"v{i} AS `{i}`" for i in values)
    return df.sparkSession.sql(
        f"SELECT * FROM {{wide}} UNPIVOT (value FOR idx IN ({picks}))", wide=wide
    ).withColumn("idx", F.col("idx").cast("int"))


def number_cells(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> list[DataFrame]:
    """Cells of numeric and temporal columns: up to one whole and one real frame."""
    whole, real = {}, {}
    for i, c in enumerate(columns):
        kind = kind_of(df.schema[c].dataType)
        if kind not in (INTEGER, DATETIME, FLOAT, DECIMAL):
            raise ValueError(f"{c} has no numeric order")
        (whole if kind in (INTEGER, DATETIME) else real)[i] = ordered_number(df, c)
    return [unpivoted(df, keys, slots) for slots in (whole, real) if slots]


def real_cells(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """All cells as doubles, for operators that only order them."""
    return unpivoted(df, keys, {i: ordered_number(df, c).cast("double") for i, c in enumerate(columns)})


def text_cells(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of any scalar columns as text."""
    return unpivoted(df, keys, {i: quoted(c).cast("string") for i, c in enumerate(columns)})


def value_counts(cells: DataFrame, group: list[str]) -> DataFrame:
    """One row per distinct value of a group: equal cells combine before the shuffle."""
    return cells.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(frames: list[DataFrame], group: list[str]) -> DataFrame:
    """Distinct values per group of each cell frame."""
    return reduce(DataFrame.unionByName, [
        value_counts(cells, group).groupBy(*group).agg(F.count(F.lit(1)).alias("unique"))
        for cells in frames])
