"""Records of CSV files, cut where they end and not where lines end, by many tasks a file.

Whether a line break lies inside quotes depends on all that comes before it in the
file.  But a stretch of a file can only do four things to that: leave it, turn it
over, or fix it either way.  So every block of a file (what Spark reads as one split) is
summed up by what it makes of either beginning, a running composition over the blocks
gives the state each one begins in, and then all blocks are cut into records at once.
Only records that go over a block's end are put together from pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framegauge.operators.joins import BROADCAST_ROWS, count_up_to, small_enough
from framegauge.session import checkpointed

# A whole quoted field, and what is left of one that is open: quotes count at the
# beginning of a field only.
QUOTED_FIELD = re.compile(r'(?<![^,])"(?:[^"]++|"")*+"')
OPEN_FIELD = re.compile(r'(?<![^,])"')
ROW_BATCH = 4096


def plain_path(path: Column) -> Column:
    """A path or name of Spark's file metadata, which is URL-encoded, as the file system has it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def as_input(paths: str | list[str]) -> str | list[str]:
    """Listed files as input paths: characters that would make them patterns are escaped."""
    return paths if isinstance(paths, str) else [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line lies inside quotes, from how it began."""
    if '"' not in line:
        return inside
    return OPEN_FIELD.search(QUOTED_FIELD.sub("", '"' + line if inside else line)) is not None


def file_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, block, row, line): lines in their order within every block of a file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(as_input(path)).select(
        plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


def _blocks(batches) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Lines of each block of (file, block, ..., line) batches, blocks one after the other."""
    def rows():
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            yield from zip(zip(*keys), batch.column(batch.num_columns - 1).to_pylist())

    for key, lines in groupby(rows(), key=lambda r: r[0]):
        yield key, (line for _, line in lines)


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, ends): whether each block begins and ends inside quotes."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside_to", pa.bool_()), ("inside_to", pa.bool_())])

    def run(batches):
        for (file, block), some in _blocks(batches):
            outside, inside = False, True
            for line in some:
                if '"' in line:
                    outside, inside = ends_inside(line, outside), ends_inside(line, inside)
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "outside_to": outside, "inside_to": inside}], schema)

    made = lines.select("file", "block", "line").mapInArrow(run, "file string, block bigint, outside_to boolean, inside_to boolean")
    # The last block that fixes the state counts, and how often it was turned over since.
    order = Window.partitionBy("file").orderBy("block")
    turned = F.sum(F.when(F.col("outside_to") & ~F.col("inside_to"), 1).otherwise(0)).over(order)
    fixed = F.when(F.col("outside_to") == F.col("inside_to"), F.struct(F.col("outside_to").alias("state"), F.col("turned").alias("at")))
    told = made.withColumn("turned", turned).withColumn("last", F.last(fixed, ignorenulls=True).over(order))
    ends = F.coalesce("last.state", F.lit(False)) != ((F.col("turned") - F.coalesce("last.at", F.lit(0))) % 2 == 1)
    told = told.withColumn("ends", ends)
    return told.select("file", "block", F.coalesce(F.lag("ends").over(order), F.lit(False)).alias("inside"), "ends")


def _cut(batches) -> Iterator[pa.RecordBatch]:
    """Records of every block; ``piece`` is 0 for whole ones, 1 for one that goes on in the
    next block, 2 for what belongs to one that has begun before."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("record", pa.string()),
                        ("header", pa.bool_()), ("piece", pa.int32())])

    def rows():
        for (file, block, began), lines in _blocks(batches):
            inside, continued, held, place, header = bool(began), bool(began), [], 0, block == 0
            for line in lines:
                held.append(line)
                inside = ends_inside(line, inside)
                if inside:
                    continue
                record = "\n".join(held)
                record = record[:-1] if record.endswith("\r") else record
                held.clear()
                if continued or record.strip():
                    yield file, block, place, record, header, 2 if continued else 0
                    header = False
                place, continued = place + 1, False
            if held:
                # A block that is inside from end to end is a middle piece.
                yield file, block, place, "\n".join(held), header, 2 if continued else 1

    waiting, size = [], 0
    for row in rows():
        waiting.append(row)
        size += len(row[3])
        if len(waiting) == ROW_BATCH or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def csv_records(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, record, header, unclosed): every record of the files, line breaks inside quotes kept.

    The first record of a file is its header.  Records of nothing but white space are
    left out.  A file whose last quote is never closed has no telling where records end:
    it gives one row without a record, with ``unclosed`` true.

    The files are read twice, block by block; no line is shuffled unless very many
    blocks begin inside quotes, when lines meet their block's state by a join.
    """
    lines = file_lines(spark, path, glob)
    states = checkpointed(block_states(lines))
    opened = states.where("inside").select(F.col("file").alias("f"), F.col("block").alias("b"), F.lit(True).alias("began"))
    some = count_up_to(opened, BROADCAST_ROWS)
    few = small_enough(opened, some)
    met = lines.join(F.broadcast(opened) if few else opened, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left")
    if not few:
        met = met.repartition("file", "block").sortWithinPartitions("file", "block", "row")
    cut = met.select("file", "block", F.coalesce("began", F.lit(False)).alias("began"), "line").mapInArrow(
        _cut, "file string, block bigint, place bigint, record string, header boolean, piece int")
    last = Window.partitionBy("file").orderBy(F.col("block").desc())
    unclosed = states.withColumn("n", F.row_number().over(last)).where("n = 1 and ends").select("file")
    marks = unclosed.select("file", F.lit(None).cast("string").alias("record"), F.lit(False).alias("header"), F.lit(True).alias("unclosed"))
    if not some and not count_up_to(unclosed, 0):
        return cut.select("file", "record", "header", F.lit(False).alias("unclosed"))
    # A piece of the second kind belongs to the last first piece before it.
    pieces = cut.where("piece > 0").join(unclosed.withColumnRenamed("file", "f"), F.col("file") == F.col("f"), "left_anti")
    so_far = Window.partitionBy("file").orderBy("block", "place")
    begun = F.last(F.when(F.col("piece") == 1, F.struct("block", "place")), ignorenulls=True).over(so_far)
    joined = pieces.withColumn("begun", begun).groupBy("file", "begun").agg(
        F.sort_array(F.collect_list(F.struct("block", "place", "record"))).alias("parts"), F.bool_or("header").alias("header"))
    joined = joined.select("file", F.array_join("parts.record", "\n").alias("record"), "header", F.lit(False).alias("unclosed"))
    whole = cut.where("piece = 0").join(unclosed.withColumnRenamed("file", "f"), F.col("file") == F.col("f"), "left_anti")
    return whole.select("file", "record", "header", F.lit(False).alias("unclosed")).unionByName(joined).unionByName(marks)
