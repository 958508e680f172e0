"""Continuous ingestion of a landing folder: admit, profile, register.

Every micro-batch is a set of new files.  Its results go to a folder named by the
batch number and replace what a failed attempt left there, so a restart neither
loses nor repeats a file.  Every file is read by its own header and typed by its
own values; files that agree in both are read together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from framegauge.functions.columns import quoted
from framegauge.plans.table_profile import profile_by_group
from framegauge.session import checkpointed, clear_scratch, scratch_mark, written
from framegauge.sources.csv_files import (
    BAD_RECORD, FILE_PATH, infer_file_types, layouts, na_token_normalize, of_layout, parsed_records, unreadable_files, with_types,
)
from framegauge.sources.csv_records import csv_records, plain_path
from framegauge.sources.dataset_store import as_analyses, dataset_id, file_admission, keep_latest, register_datasets

# The file source matches names with their case.
CSV_GLOB = "*.[cC][sS][vV]"
# Files of one micro-batch; the driver holds a name, a header and a type per column of each.
MAX_FILES = 1000

Part = tuple[DataFrame, DataFrame, DataFrame]


def landing_stream(spark: SparkSession, folder: str, max_files: int = MAX_FILES) -> DataFrame:
    """New CSV files of a folder; their contents are not read here."""
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", CSV_GLOB)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder))
    meta = F.col("_metadata")
    return files.select(plain_path(meta["file_path"]).alias("file_path"), plain_path(meta["file_name"]).alias("file_name"),
                        meta["file_size"].alias("file_size"))


def _profiled(listed: DataFrame, text: DataFrame, kinds: dict[str, str], names: list[str], owner: int) -> tuple[DataFrame, DataFrame]:
    """Registry rows and analyses of files with the same columns and kinds."""
    typed = with_types(text, kinds)
    keyed = typed.withColumn("dataset_id", dataset_id(F.col(FILE_PATH))).drop(FILE_PATH)
    sections = checkpointed(profile_by_group(keyed, "dataset_id").analyses())
    analyses = as_analyses(sections, "dataset_id")
    rows = listed.withColumn("dataset_id", dataset_id(F.col("file_path"))).join(
        sections.select("dataset_id", F.col("summary.rows").alias("rows")), "dataset_id").select("file_path", "rows")
    return register_datasets(listed, rows, len(names), owner), analyses


def profile_batch(files: DataFrame, owner: int, max_bytes: int | None = None) -> Part:
    """Registry rows and analyses of the readable ones of listed CSV files, and the rejected files.

    A file without data rows is registered with 0 rows and has no analysis; one without
    a header, or with a quote that is never closed, is unreadable.  The files are cut
    into records once, which are written to the scratch folder.
    """
    spark = files.sparkSession
    judged = checkpointed(file_admission(files, ("csv",), max_bytes))
    paths = [r["file_path"] for r in judged.where("admitted").select("file_path").collect()]
    if judged.select(dataset_id(F.col("file_path"))).distinct().count() < judged.count():
        raise ValueError("two files of one batch have the same dataset id")
    registered, analyses, rejected = [], [], [judged.where("not admitted").select("file_path", "reason")]
    records = written(csv_records(spark, paths), "csv-records") if paths else None
    headed = {r["file"]: r["record"] for r in records.where("header").select("file", "record").collect()} if paths else {}

    def reject(some) -> None:
        if some:
            rejected.append(judged.where(F.col("file_path").isin(*some)).select("file_path", F.lit("unreadable").alias("reason")))

    reject([p for p in paths if p not in headed])
    kinds_of_header = layouts(records) if paths else []
    for names, headers in kinds_of_header:
        group = [p for p in paths if headed.get(p) in headers]
        raw = parsed_records(of_layout(records, headers if len(kinds_of_header) > 1 else None).where("not unclosed"), names)
        bad = {r[FILE_PATH] for r in unreadable_files(raw, len(names)).select(FILE_PATH).collect()}
        reject(bad)
        good = [p for p in group if p not in bad]
        if not good:
            continue
        text = raw.drop(BAD_RECORD)
        text = na_token_normalize(text.where(~F.col(FILE_PATH).isin(*bad)) if bad else text, names)
        kinds = infer_file_types(text, names)
        empty = [p for p in good if p not in kinds]
        if empty:
            none = spark.createDataFrame([], "file_path string, rows bigint")
            registered.append(register_datasets(judged.where(F.col("file_path").isin(*empty)), none, len(names), owner))
        alike: dict[tuple[str, ...], list[str]] = {}
        for path, found in kinds.items():
            alike.setdefault(tuple(found[n] for n in names), []).append(path)
        for of_kinds, some in sorted(alike.items()):
            part = text.where(F.col(FILE_PATH).isin(*some)) if len(some) < len(good) else text
            datasets, found = _profiled(judged.where(F.col("file_path").isin(*some)), part, dict(zip(names, of_kinds)), names, owner)
            registered.append(datasets)
            analyses.append(found)
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if not registered:
        registered = [register_datasets(judged.limit(0), spark.createDataFrame([], "file_path string, rows bigint"), 0, owner)]
    return union(registered), union(analyses) if analyses else None, union(rejected)


def ingest_stream(
    spark: SparkSession, folder: str, store: str, owner: int, max_bytes: int | None = None, max_files: int = MAX_FILES,
    available_now: bool = True,
) -> StreamingQuery:
    """Start ingestion of ``folder`` into ``store``; ends by itself if ``available_now``.

    Files of any header and of any size are taken, unless ``max_bytes`` sets a limit.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        mark = scratch_mark(spark)
        for name, frame in zip(("datasets", "analyses", "rejected"), profile_batch(batch, owner, max_bytes)):
            if frame is not None:
                frame.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
        clear_scratch(spark, mark)

    writer = (landing_stream(spark, folder, max_files).writeStream
              .option("checkpointLocation", f"{store}/checkpoint").foreachBatch(write_batch))
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def ingested(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Registry and analyses written so far."""
    return (spark.read.parquet(f"{store}/datasets").drop("batch"),
            keep_latest(spark.read.parquet(f"{store}/analyses").drop("batch")))
