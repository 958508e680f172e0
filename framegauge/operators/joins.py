"""Joins of a large frame with a smaller keyed one, safe under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.functions.columns import fixed_width, quoted

# A keyed side is broadcast only when it was measured to be within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# Shares that the rows of one owner are ranked in before they meet.
SALTS = 64


def count_up_to(df: DataFrame, cap: int) -> int:
    """Row count, as ``cap + 1`` if it is larger; counted within tasks, then summed."""
    return min(df.count(), cap + 1)


def small_enough(keyed: DataFrame, rows: int) -> bool:
    """Whether a frame of ``rows`` rows may be broadcast: few rows and few bytes.

    Only columns of variable width have to be measured.
    """
    if rows > BROADCAST_ROWS:
        return False
    widths = {f.name: fixed_width(f.dataType) for f in keyed.schema}
    wide = [quoted(c) for c, w in widths.items() if not w]
    size = rows * (16 + sum(widths.values()))
    if wide and size <= BROADCAST_BYTES:
        texts = sum((F.coalesce(F.octet_length(c.cast("string")).cast("bigint"), F.lit(0)) for c in wide), F.lit(0))
        size += keyed.agg(F.coalesce(F.sum(texts), F.lit(0)).alias("b")).first()["b"]
    return size <= BROADCAST_BYTES


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join in which a missing key matches a missing key, as in grouping."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in on})
    matched = F.lit(True)
    for c in on:
        matched = matched & quoted(c).eqNullSafe(quoted(f"__{c}"))
    return left.join(renamed, matched, how).drop(*[f"__{c}" for c in on])


def keyed_join(large: DataFrame, keyed: DataFrame, on: list[str], how: str, keyed_rows: int) -> DataFrame:
    """Join ``large`` with ``keyed`` (unique on ``on``) without a hot task.

    ``keyed_rows`` is the measured size of ``keyed``.  A small one is broadcast.  A
    larger one gets no hint: both sides shuffle on the key once, nothing is copied,
    and adaptive execution splits the partitions of hot keys.  For that ``keyed``
    should be read from where it was written, not come out of an aggregate.
    """
    return null_safe_join(large, F.broadcast(keyed) if small_enough(keyed, keyed_rows) else keyed, on, how)
