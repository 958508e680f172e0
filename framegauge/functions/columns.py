"""Column kinds, the missing-value rule and per-column byte widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER = "integer"
FLOAT = "float"
DECIMAL = "decimal"
BOOLEAN = "boolean"
STRING = "string"
DATETIME = "datetime"
COMPLEX = "complex"

NUMERIC_KINDS = (INTEGER, FLOAT, DECIMAL)
CATEGORICAL_KINDS = (STRING, BOOLEAN)

# Storage width in bytes of a fixed-width value.
FIXED_WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8,
    "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def quoted(name: str) -> Column:
    """Column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(dtype, T.DecimalType):
        return DECIMAL
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return COMPLEX


def columns_of_kind(df: DataFrame, *kinds: str, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if kind_of(f.dataType) in kinds and f.name not in skip]


def numeric_columns(df: DataFrame) -> DataFrame:
    """The numeric columns of ``df``; booleans are not numeric."""
    return df.select(*[quoted(c) for c in columns_of_kind(df, *NUMERIC_KINDS)])


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into null and -0.0 into 0.0, so that equal values have one representation."""
    return df.select(*[
        F.when(~F.isnan(quoted(f.name)), quoted(f.name) + F.lit(0.0).cast(f.dataType)).alias(f.name)
        if kind_of(f.dataType) == FLOAT else quoted(f.name)
        for f in df.schema
    ])


def micros(col: Column) -> Column:
    """Microseconds since the epoch of a date or timestamp."""
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column) -> Column:
    return F.timestamp_micros(F.round(col).cast("bigint")).cast("timestamp_ntz")


def text_bytes(col: Column, dtype: T.DataType) -> Column | None:
    """Byte length of a variable-width value, None where the width is fixed."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        return F.octet_length(col).cast("bigint")
    return None


def fixed_width(dtype: T.DataType) -> int:
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return FIXED_WIDTHS.get(dtype.simpleString(), 0)


def column_dtypes(df: DataFrame) -> DataFrame:
    """One row per column: position, name, kind and Spark type string."""
    rows = [(i, f.name, kind_of(f.dataType), f.dataType.simpleString())
            for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, kind string, dtype string")
