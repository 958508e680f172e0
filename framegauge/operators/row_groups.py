"""Counts of small groups of rows, many at a time, from rows sorted by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.columns import DECIMAL, NUMERIC_KINDS, kind_of, quoted
from framegauge.operators.cells import key_names, keys_aliased, keys_restored, ordered_number

# Types whose values Arrow tells apart as Spark's grouping does.
PLAIN_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType,
               T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
FENCE_FACTOR = 1.5


def plain_types(df: DataFrame) -> bool:
    """Whether ``row_group_counts`` can tell the rows of ``df`` apart."""
    return all(isinstance(f.dataType, PLAIN_TYPES) or f.dataType == T.StringType() for f in df.schema)


def _changes(column: pa.Array) -> np.ndarray:
    """By row from the second on: whether the value is another than the one before; null is a value."""
    before, after = column[:-1], column[1:]
    other = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        there = column.is_valid().to_numpy(zero_copy_only=False)
        other = other | (there[:-1] != there[1:])
    return other


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As in SQL, where NaN is the largest number."""
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def outliers_of_groups(values: np.ndarray, number: np.ndarray, groups: int) -> np.ndarray:
    """Values outside their group's fences, by group; NaN is none, ``number`` is ascending."""
    there = ~np.isnan(values)
    v, g = values[there], number[there]
    v = v[np.lexsort((v, g))]
    n = np.bincount(g, minlength=groups)
    some = np.flatnonzero(n)
    total, start = n[some], (np.cumsum(n) - n)[some]

    def quartile(prob: float) -> np.ndarray:
        at = (total - 1) * prob
        floor = np.floor(at)
        low, high = v[start + floor.astype(np.int64)], v[start + np.ceil(at).astype(np.int64)]
        step, weight = high - low, at - floor
        return np.where(low == high, low, np.where(weight < 0.5, low + step * weight, high - step * (1 - weight)))

    with np.errstate(all="ignore"):
        q1, q3 = quartile(0.25), quartile(0.75)
        spread = q3 - q1
        lower, upper = np.repeat(q1 - spread * FENCE_FACTOR, total), np.repeat(q3 + spread * FENCE_FACTOR, total)
        outside = _less(v, lower) | _less(upper, v)
    return np.bincount(g[outside], minlength=groups)


def _greatest(column: pa.Array, starts: np.ndarray) -> pa.Array:
    """The largest date or time of every group, null without one."""
    whole = pa.int32() if pa.types.is_date32(column.type) else pa.int64()
    least = np.iinfo(whole.to_pandas_dtype()).min
    numbers = pc.fill_null(column.cast(whole), least).to_numpy(zero_copy_only=False)
    none = np.logical_and.reduceat(column.is_null().to_numpy(zero_copy_only=False), starts)
    return pa.array(np.maximum.reduceat(numbers, starts), whole, mask=none).cast(column.type)


def row_group_counts(df: DataFrame, keys: tuple[str, ...], latest: str | None = None) -> DataFrame:
    """(keys, rows, missing_cells, duplicate_rows, outlier_cells, latest?) of groups that are all small.

    ``df`` has missing values normalized; ``latest`` is a date or time, of which the largest is taken.

    Rows are shuffled by group once and sorted in their partition, by their digest within a
    group and by themselves where digests meet, so that equal rows are neighbours.  A task
    holds a batch of rows and the group that it ends in.
    """
    others = [c for c in df.columns if c not in keys]
    short, cells = key_names(keys), [f"c{i}" for i in range(len(others))]
    numbers = {c: name for c, name in zip(others, cells) if kind_of(df.schema[c].dataType) in NUMERIC_KINDS}
    exact = {name: f"v{name}" for c, name in numbers.items() if kind_of(df.schema[c].dataType) == DECIMAL}
    rows = df.select(*keys_aliased(keys), *[quoted(c).alias(name) for c, name in zip(others, cells)],
                     *[ordered_number(df, c).cast("double").alias(exact[name]) for c, name in numbers.items() if name in exact])
    newest = [cells[others.index(latest)]] if latest else []
    counts = ("rows", "missing_cells", "duplicate_rows", "outlier_cells")
    digest = [F.xxhash64(*cells)] if cells else []
    ordered = rows.repartition(*short).sortWithinPartitions(*short, *digest, *cells)

    def counted(table: pa.RecordBatch, first: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(first)
        number, groups = np.cumsum(first) - 1, len(starts)
        gaps, outliers = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
        for name in cells:
            column = table.column(name)
            if column.null_count:
                gaps += np.bincount(number[column.is_null().to_numpy(zero_copy_only=False)], minlength=groups)
        for name in numbers.values():
            column = table.column(exact.get(name, name))
            values = column.to_numpy(zero_copy_only=False).astype(np.float64)
            outliers += outliers_of_groups(values, number, groups)
        return pa.RecordBatch.from_arrays(
            [*[table.column(k).take(pa.array(starts)) for k in short], pa.array(np.bincount(number, minlength=groups)), pa.array(gaps),
             pa.array(np.bincount(number[same], minlength=groups)), pa.array(outliers),
             *[_greatest(table.column(name), starts) for name in newest]],
            [*short, *counts, *newest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            first, same = _marks(batch)
            end = int(np.flatnonzero(first)[-1])
            if end:
                yield counted(batch.slice(0, end), first[:end], same[:end])
            held = batch.slice(end)
        if held is not None:
            yield counted(held, *_marks(held))

    def _marks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start a group, and rows equal to the one before in the group."""
        first, other = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
        first[0] = True
        for k in short:
            first[1:] |= _changes(batch.column(k))
        for name in cells:
            other[1:] |= _changes(batch.column(name))
        return first, ~(first | other)

    schema = T.StructType([*[T.StructField(s, df.schema[k].dataType) for k, s in zip(keys, short)],
                           *[T.StructField(c, T.LongType()) for c in counts], *[rows.schema[c] for c in newest]])
    return ordered.mapInArrow(run, schema).select(*keys_restored(keys), *counts, *[F.col(c).alias(latest) for c in newest])
