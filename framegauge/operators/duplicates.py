"""Rows that repeat an earlier row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.columns import normalize_missing, quoted
from framegauge.operators.joins import BROADCAST_ROWS, count_up_to, small_enough
from framegauge.session import checkpointed


def duplicate_rows(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows minus distinct rows, per group if keys are given.

    Equal rows are combined before the shuffle, so neither a frequent row nor a hot
    group meets in one task.  A table as a whole is shuffled as 128-bit digests first;
    whole rows are compared only where digests meet, as long as those are few enough to
    be broadcast.  More of them, groups, and columns without a hash go by the whole row.
    """
    clean = normalize_missing(df)
    if not keys and df.columns and all(_hashed(f.dataType) for f in df.schema):
        columns = [quoted(c) for c in df.columns]
        # Hashes pass over nulls, so where these are is hashed as well.
        gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
        digest = [F.xxhash64(*columns).alias("__h1"), F.xxhash64(gaps, *columns).alias("__h2")]
        met = checkpointed(clean.select(*digest).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        some = count_up_to(met, BROADCAST_ROWS)
        if small_enough(met, some):
            clean = clean.select(*digest, "*").join(F.broadcast(met), ["__h1", "__h2"], "left_semi").drop("__h1", "__h2")
    copies = clean.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.groupBy(*[quoted(k) for k in keys]).agg(
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"))


def _hashed(dtype: T.DataType) -> bool:
    """Whether Spark has a hash of such values."""
    if isinstance(dtype, T.ArrayType):
        return _hashed(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashed(f.dataType) for f in dtype)
    return not isinstance(dtype, (T.MapType, T.VariantType))
