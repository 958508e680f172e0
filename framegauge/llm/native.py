"""Small helpers for operators made of built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.session import checkpointed

# A table is broadcast only after it was measured and found no larger.
BROADCAST_BYTES = 16 << 20
# ASCII white space, as Java and RE2 write it.
SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; none for a null one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def measured(df: DataFrame, size: Column) -> DataFrame:
    """``df`` written out, with a broadcast hint if ``size`` bytes a row make it small.

    Larger tables get no hint and are joined by a shuffle that adaptive execution can
    split where a key is hot.
    """
    written = checkpointed(df)
    bytes_ = written.agg(F.coalesce(F.sum(size.cast("bigint") + 64), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(written) if bytes_ <= BROADCAST_BYTES else written
