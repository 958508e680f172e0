"""Columns worked out from one column in Arrow batches, all others passed through."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framegauge.functions.columns import quoted


def row_slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A record batch in slices, so that what is made of it stays small."""
    return map(batch.slice, range(0, batch.num_rows, rows), repeat(rows))


def tidy() -> None:
    """Hand freed memory back, so that a worker's next operator does not start with this one's."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidied(run: Callable) -> Callable:
    """``run`` over a partition's batches, with ``tidy`` after it."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


# The operator whose tables this worker holds between tasks, and the tables.
_held: list = [None, None]


def held(owner: tuple, make: Callable):
    """``make()``, kept in this worker until another owner asks: one operator's tables at a time."""
    if _held[0] != owner:
        _held[:] = [None, None]
        tidy()
        _held[:] = [owner, make()]
    return _held[1]


def with_computed(df: DataFrame, source: str, fields: list[T.StructField],
                  convert: Callable[[pa.Array], list[pa.Array]], keep_source: bool = True) -> DataFrame:
    """``df`` with ``convert`` of the column ``source`` as the columns ``fields``.

    Columns with the names of the new ones are replaced, all others passed through,
    whatever their names: in between they are known by position.  ``source`` goes to
    the workers once, and comes back only with ``keep_source``.
    """
    new = {f.name for f in fields}
    others = [f for f in df.schema if f.name not in new and f.name != source]
    back = [f for f in df.schema if f.name == source and keep_source and source not in new]
    inner = df.select(quoted(source).alias("source"), *[quoted(f.name).alias(f"c{i}") for i, f in enumerate(others)])
    kept = [*back, *others]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept)]
                          + [T.StructField(f"n{i}", f.dataType, f.nullable) for i, f in enumerate(fields)])
    skip = 0 if back else 1

    def run(batches):
        for batch in batches:
            for rows in row_slices(batch):
                columns = [*rows.columns[skip:], *convert(rows.column(0))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    names = [f.name for f in kept] + [f.name for f in fields]
    made = inner.mapInArrow(tidied(run), schema).toDF(*names)
    order = [f.name for f in df.schema if f.name in {k.name for k in kept}] + [f.name for f in fields]
    return made.select(*map(quoted, order)) if names != order else made
