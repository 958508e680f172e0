"""Files in and out of the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framegauge.sources.csv_files import BAD_RECORD, FILE_PATH, csv_text, writer_options
from framegauge.sources.csv_records import plain_path

# What is admitted by default.
ALLOWED_EXTENSIONS = ("csv", "json", "parquet", "orc")


def extension_of(path: Column) -> Column:
    """Lower-cased extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def file_listing(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Files under a path with size and time; contents are not read.

    Spark leaves out files of zero bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    meta = F.col("_metadata")
    return reader.load(path).select(
        plain_path(meta["file_path"]).alias("file_path"), plain_path(meta["file_name"]).alias("file_name"),
        meta["file_size"].alias("file_size"), meta["file_modification_time"].alias("modified_at"))


def file_admission(
    files: DataFrame, allowed: tuple[str, ...] = ALLOWED_EXTENSIONS, max_bytes: int | None = None,
) -> DataFrame:
    """Each listed file with ``admitted`` and the reason for a rejection.

    Sizes are only limited where ``max_bytes`` asks for it.
    """
    extension = extension_of(F.col("file_name"))
    reason = (F.when(F.length("file_name") == 0, "invalid name")
              .when(~extension.isin(*[a.lower() for a in allowed]), "extension not supported")
              .when(F.lit(False) if max_bytes is None else F.col("file_size") > max_bytes, "file too large")
              .when(F.col("file_size") == 0, "empty file"))
    return (files.withColumn("file_type", extension).withColumn("reason", reason)
            .withColumn("admitted", F.col("reason").isNull()))


def dataset_id(path: Column) -> Column:
    return F.xxhash64(path)


def register_datasets(
    files: DataFrame, rows: DataFrame, columns: int, owner: int, uploaded_at: Column | None = None,
) -> DataFrame:
    """One registry row per admitted file.

    ``rows`` holds (file_path, rows); a file without any row is not in it and
    counts 0.
    """
    identity = dataset_id(F.col("file_path"))
    return (files.join(rows.select("file_path", "rows"), "file_path", "left").select(
        identity.alias("id"), F.lit(owner).cast("bigint").alias("owner_id"),
        F.concat(F.lower(F.hex(identity)), F.lit("."), F.col("file_type")).alias("filename"),
        F.col("file_name").alias("original_filename"), "file_type", "file_size", "file_path",
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        F.lit(columns).cast("int").alias("columns"),
        (uploaded_at if uploaded_at is not None else F.current_timestamp()).cast("timestamp_ntz")
        .alias("uploaded_at")))


def rows_per_file(df: DataFrame, path_column: str = "_file_path") -> DataFrame:
    return df.groupBy(F.col(path_column).alias("file_path")).agg(F.count(F.lit(1)).alias("rows"))


def keep_latest(analyses: DataFrame) -> DataFrame:
    """One analysis per dataset: the newest, of equally new ones the largest id.

    The rank filter runs before the shuffle too, so many versions of one dataset
    do not meet in one task.
    """
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (analyses.withColumn("__version", F.row_number().over(newest))
            .where(F.col("__version") == 1).drop("__version"))


def as_analyses(sections: DataFrame, key: str, created_at: Column | None = None) -> DataFrame:
    """Stored form of nested profile sections keyed by dataset id."""
    stamp = created_at if created_at is not None else F.current_timestamp().cast("timestamp_ntz")
    return sections.select(
        F.xxhash64(F.lit("analysis"), F.col(key)).alias("id"), F.col(key).alias("dataset_id"),
        *[F.col(c) for c in sections.columns if c != key], stamp.alias("created_at"))


def persist_analyses(analyses: DataFrame, path: str, mode: str = "append") -> None:
    analyses.write.mode(mode).parquet(path)


def load_analyses(spark: SparkSession, path: str) -> DataFrame:
    return keep_latest(spark.read.parquet(path))


def load_dataset(spark: SparkSession, datasets: DataFrame, dataset: int, owner: int) -> tuple[DataFrame, str] | None:
    """The stored table of a registry row and its original name, None if not found.

    A stored CSV file is read as text, with line breaks in quotes.
    """
    found = (datasets.where((F.col("id") == dataset) & (F.col("owner_id") == owner))
             .select("file_path", "file_type", "original_filename").take(1))
    if not found:
        return None
    row = found[0]
    try:
        if row["file_type"] == "csv":
            return csv_text(spark, row["file_path"]).drop(BAD_RECORD, FILE_PATH), row["original_filename"]
        return spark.read.format(row["file_type"]).load(row["file_path"]), row["original_filename"]
    except Exception as error:  # a missing path is "not found", anything else is a fault
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def export_dataset(
    spark: SparkSession, datasets: DataFrame, dataset: int, owner: int, folder: str, fmt: str | None = None,
) -> str | None:
    """Write a stored table under its original name; the path, or None if not found."""
    loaded = load_dataset(spark, datasets, dataset, owner)
    if loaded is None:
        return None
    df, name = loaded
    target = f"{folder.rstrip('/')}/{name}"
    writer = df.write.mode("errorifexists").format(fmt or name.rsplit(".", 1)[-1])
    (writer.options(**writer_options()) if (fmt or name).endswith("csv") else writer).save(target)
    return target
