"""CSV files as typed tables."""

from __future__ import annotations

import csv
import io
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.columns import BOOLEAN, FLOAT, INTEGER, STRING, quoted
from framegauge.operators.joins import BROADCAST_ROWS, count_up_to, keyed_join
from framegauge.session import checkpointed, written
from framegauge.sources.csv_records import csv_records

# Cell texts that mean "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cell texts that are booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"

BAD_RECORD = "_bad_record"
FILE_PATH = "_file_path"


def writer_options() -> dict[str, str]:
    """How a table is written so that ``csv_scan`` gets every cell back."""
    return {"header": "true", "quote": '"', "escape": '"', "emptyValue": "",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def unique_names(header: list[str]) -> list[str]:
    """Repeated names get .1, .2, ...; a missing name is numbered by position.

    Names that differ in case only count as repeated, as column names do in Spark.
    """
    seen: Counter[str] = Counter()
    names, taken = [], set()
    for i, raw in enumerate(header):
        base = name = raw if raw else f"Unnamed: {i}"
        while name.lower() in taken:
            seen[base.lower()] += 1
            name = f"{base}.{seen[base.lower()]}"
        names.append(name)
        taken.add(name.lower())
    return names


def layouts(records: DataFrame) -> list[tuple[list[str], list[str]]]:
    """(column names, header records that give them) of ``csv_records``, by the first file that has them.

    What is collected is a row per different header, however many files there are.
    """
    heads = records.where("header").groupBy("record").agg(F.min("file").alias("file")).collect()
    found: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(heads, key=lambda r: r["file"]):
        names = unique_names(next(csv.reader(io.StringIO(r["record"], newline="")), []) or [""])
        found.setdefault(tuple(names), []).append(r["record"])
    return [(list(names), raw) for names, raw in found.items()]


def of_layout(records: DataFrame, headers: list[str] | None) -> DataFrame:
    """The records below the headers: all, or those of the files with one of ``headers``."""
    below = records.where("not header")
    if headers is None:
        return below
    files = checkpointed(records.where(F.col("header") & F.col("record").isin(*headers)).select("file").distinct())
    return keyed_join(below, files, ["file"], "left_semi", count_up_to(files, BROADCAST_ROWS))


def parsed_records(records: DataFrame, names: list[str]) -> DataFrame:
    """Records as text columns ``names``, with the unreadable-record text and the file of each row.

    A file whose last quote stays open counts as a record of too many fields.
    """
    fields = [*(f"c{i}" for i in range(len(names))), BAD_RECORD]
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    row = F.from_csv("record", ", ".join(f"{f} string" for f in fields), options)
    # Through an array, so that a record is parsed once and not once for each column.
    rows = records.select("file", "unclosed", F.inline(F.array(row)))
    bad = F.when(F.col("unclosed"), F.lit("," * len(names))).otherwise(F.col(BAD_RECORD))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], bad.alias(BAD_RECORD), F.col("file").alias(FILE_PATH))


def csv_text(spark: SparkSession, path: str | list[str], names: list[str] | None = None) -> DataFrame:
    """All columns as text, with the unreadable-record text and the file of each row.

    ``names`` are those of the columns; without them the files must agree in their header.
    """
    records = csv_records(spark, path)
    if names is None:
        found = layouts(records)
        if len(found) != 1:
            raise ValueError(f"{len(found)} different headers in {path}")
        names = found[0][0]
    return parsed_records(of_layout(records, None), names)


def na_token_normalize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value tokens of text columns as null."""
    chosen = set(columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])
    return df.select(*[
        F.when(~quoted(c).isin(*NA_TOKENS), quoted(c)).alias(c) if c in chosen else quoted(c)
        for c in df.columns])


def _is_integer(col: Column) -> Column:
    return col.rlike(INTEGER_PATTERN) & F.trim(col).try_cast("bigint").isNotNull()


def _is_float(col: Column) -> Column:
    return col.rlike(FLOAT_PATTERN) | col.rlike(INFINITY_PATTERN)


def _kind_counts(names: list[str]) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        col = quoted(c)
        aggs += [F.count(col).alias(f"n{i}"), F.count_if(_is_integer(col)).alias(f"i{i}"),
                 F.count_if(_is_float(col)).alias(f"f{i}"),
                 F.count_if(col.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"b{i}")]
    return aggs


def infer_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Kind of every text column, from one aggregate over normalised text.

    Integers with gaps are floats, booleans with gaps stay text, and a column
    without any value is a float.
    """
    names = columns or df.columns
    return _kinds(names, df.agg(*_kind_counts(names)).first())


def infer_file_types(df: DataFrame, columns: list[str]) -> dict[str, dict[str, str]]:
    """Kinds of the columns of every file that has rows, each by its own values."""
    counts = df.groupBy(FILE_PATH).agg(*_kind_counts(columns))
    return {r[FILE_PATH]: _kinds(columns, r) for r in counts.collect()}


def _kinds(names: list[str], found) -> dict[str, str]:
    kinds = {}
    for i, c in enumerate(names):
        present, rows = found[f"n{i}"], found["rows"]
        if present == 0:
            kinds[c] = STRING if rows == 0 else FLOAT
        elif found[f"i{i}"] == present:
            kinds[c] = INTEGER if present == rows else FLOAT
        elif found[f"f{i}"] == present:
            kinds[c] = FLOAT
        elif found[f"b{i}"] == present and present == rows:
            kinds[c] = BOOLEAN
        else:
            kinds[c] = STRING
    return kinds


def _typed(col: Column, kind: str) -> Column:
    if kind == INTEGER:
        return F.trim(col).cast("bigint")
    if kind == FLOAT:
        return F.trim(col).cast("double")
    if kind == BOOLEAN:
        return F.when(col.isin(*TRUE_TOKENS), True).when(col.isin(*FALSE_TOKENS), False)
    return col


def with_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*[_typed(quoted(c), kinds[c]).alias(c) if c in kinds else quoted(c) for c in df.columns])


def csv_scan(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV files as a typed table; every file is read by its own header.

    Line breaks inside quotes belong to their cell, and a large file is read by many
    tasks all the same.  The records are written to the scratch folder once, and
    headers, unreadable records and kinds found there.  Without a schema the kinds are
    inferred from the whole data.  A record with more fields than its header, a quote
    that is never closed, or headers with different columns raise an error that names
    the files: nothing is dropped in silence.
    """
    records = written(csv_records(spark, path), "csv-records")
    found = layouts(records)
    broken = [r["file"] for r in records.where("unclosed").select("file").take(5)]
    if broken:
        raise ValueError(f"a quote that is never closed in {broken}")
    if not found:
        raise ValueError(f"no header in {path}")
    order = schema.fieldNames() if schema is not None else found[0][0]
    parts = []
    for names, headers in found:
        below = of_layout(records, headers if len(found) > 1 else None)
        if set(names) != set(order):
            files = records.where(F.col("header") & F.col("record").isin(*headers)).select("file").take(5)
            raise ValueError(f"columns {sorted(names)} instead of {sorted(order)} in {[r['file'] for r in files]}")
        raw = parsed_records(below, names)
        bad = unreadable_files(raw, len(names)).select(FILE_PATH).take(5)
        if bad:
            raise ValueError(f"records with too many fields in {[r[0] for r in bad]}")
        parts.append(raw.select(*[quoted(c) for c in order]))
    text = na_token_normalize(reduce(DataFrame.unionByName, parts))
    if schema is not None:
        return text.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return with_types(text, infer_types(text))


def field_count(record: Column) -> Column:
    """Fields of a raw CSV record, commas inside quotes not counted."""
    bare = F.regexp_replace(record, r'"(?:[^"]++|"")*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def unreadable_files(text: DataFrame, width: int) -> DataFrame:
    """Files with a record that has more fields than the header.

    Short records are no error; their missing fields are null.
    """
    names = [c for c in text.columns if c not in (BAD_RECORD, FILE_PATH)]
    # Records are only checked as far as they are parsed, so all columns are read.
    parsed = F.length(F.concat_ws("", *[quoted(c) for c in names])) >= 0
    extra = F.col(BAD_RECORD).isNotNull() & (field_count(F.col(BAD_RECORD)) > width) & parsed
    return text.where(extra).groupBy(FILE_PATH).agg(F.count(F.lit(1)).alias("bad_records"))


def reject_unreadable(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the readable files, and the rejected files.

    ``text`` comes from ``csv_text``; a file with one unreadable record is
    rejected as a whole.
    """
    names = [c for c in text.columns if c not in (BAD_RECORD, FILE_PATH)]
    bad = checkpointed(unreadable_files(text, len(names)))
    rejected = count_up_to(bad, BROADCAST_ROWS)
    if rejected == 0:
        return text.drop(BAD_RECORD), bad
    return keyed_join(text, bad, [FILE_PATH], "left_anti", rejected).drop(BAD_RECORD), bad
