"""Values as JSON text: ISO times, interval text, NaN as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.columns import quoted


def iso_timestamp(ts: Column) -> Column:
    """ISO text; the fraction only where there is one, with six digits."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def json_safe(col: Column, dtype: T.DataType) -> Column:
    """``col`` with every nested value in a JSON-safe form."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.when(col.isNotNull(), iso_timestamp(col))
    if isinstance(dtype, T.DateType):
        return F.when(col.isNotNull(), iso_timestamp(col.cast("timestamp_ntz")))
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return col.cast("string")
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda v: json_safe(v, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: json_safe(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [json_safe(col[f.name], f.dataType).alias(f.name) for f in dtype]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col


def json_safe_columns(df: DataFrame) -> DataFrame:
    return df.select(*[json_safe(quoted(f.name), f.dataType).alias(f.name) for f in df.schema])


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON object, missing values kept as null."""
    safe = json_safe_columns(df)
    return safe.select(F.to_json(F.struct(*[quoted(c) for c in safe.columns]),
                                 {"ignoreNullFields": "false"}).alias(name))
