"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Cell (i, b) of the matrix says how many rows of input partition i go to bin b; a bin is
a stretch of slots of a shard.  Row sums are the partitions' sizes, column sums the
bins', and drawn as those of a random permutation the cells are multivariate
hypergeometric.  Nobody holds the matrix: halves of the partitions share the bins'
places by one vector draw, each half again, down to a partition.  The generator of a
draw is keyed by the seed and the range of partitions, so every task makes the same
draws on its way down, and knows besides how many rows of each bin come from before it.

A task then permutes its rows, deals them to the bins, and the rows of a bin are
permuted once more where they arrive.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegauge.functions.columns import quoted
from framegauge.session import checkpointed

# Slots of a bin: what a task permutes at a time after the exchange.
BIN_ROWS = 1 << 20
# Populations up to here are drawn by numpy; its sampler takes fewer than 1e9.
NUMPY_ROWS = 900_000_000
# Standard deviations around the mode; what lies beyond has less weight than a double resolves.
TAIL = 9


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k & 0xFFFFFFFFFFFFFFFF for k in key])))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` of ``good + bad`` things are good; for numbers of any size.

    Beyond numpy's range by inversion: the weights around the mode follow from each
    other by the ratio of neighbours, and beyond the window there is nothing left.
    """
    total = good + bad
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    if total < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, drawn))
    spread = (drawn / total * good / total * bad * (total - drawn) / max(total - 1, 1)) ** 0.5
    mode = (drawn + 1) * (good + 1) // (total + 2)
    reach = int(TAIL * spread) + 64
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def shares(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` things, drawn without replacement, have each colour of ``sizes``."""
    total = int(sizes.sum())
    if total < NUMPY_ROWS:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    out = np.zeros(len(sizes), dtype=np.int64)
    for k, size in enumerate(sizes.tolist()):
        out[k] = hypergeometric(rng, size, total - size, drawn)
        total, drawn = total - size, drawn - int(out[k])
        if not drawn:
            break
    return out


def matrix_row(before: np.ndarray, partition: int, bins: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that ``partition`` sends to each bin, and those that all partitions before it send.

    ``before`` has the rows before each partition, and all rows at its end.
    """
    low, high = 0, len(before) - 1
    own, earlier = bins.astype(np.int64), np.zeros(len(bins), dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = shares(generator(seed, 1, low, high), own, int(before[middle] - before[low]))
        if partition < middle:
            own, high = left, middle
        else:
            own, earlier, low = own - left, earlier + left, middle
    return own, earlier


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Equal sizes, the first shards one row more where they do not divide the rows."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def bins_of(sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of the bins that shards of ``sizes`` are cut into."""
    cut = [(k, start, min(most, size - start)) for k, size in enumerate(sizes) for start in range(0, size, most)]
    return tuple(np.array(column, dtype=np.int64) for column in zip(*cut)) if cut else (np.zeros(0, dtype=np.int64),) * 3


def _dealt(before, bins, seed, schema):
    """Each row of this partition with its bin and its number among the bin's arrivals."""

    def run(batches):
        partition = TaskContext.get().partitionId()
        n = int(before[partition + 1] - before[partition])
        if not n:
            return
        own, earlier = matrix_row(before, partition, bins, seed)
        target = np.repeat(np.arange(len(own)), own)
        arrival = np.repeat(earlier - (np.cumsum(own) - own), own) + np.arange(n)
        order = generator(seed, 2, partition).permutation(n)
        target, arrival = target[order], arrival[order]
        at = 0
        for batch in batches:
            to = at + batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(target[at:to], pa.int64()), pa.array(arrival[at:to], pa.int64())], schema)
            at = to
        if at != n:
            raise RuntimeError(f"partition {partition} has {at} rows and had {n} when it was counted")

    return run


def _slotted(shard, first, bins, seed, schema):
    """Bins in place of which rows get their shard and, permuted within the bin, their slot."""

    def run(batches):
        @lru_cache(maxsize=1)
        def slots(b: int) -> np.ndarray:
            return first[b] + generator(seed, 3, b).permutation(int(bins[b]))

        for batch in batches:
            target, arrival = (batch.column(i).to_numpy() for i in (-2, -1))
            slot = np.empty(batch.num_rows, dtype=np.int64)
            cuts = np.flatnonzero(np.diff(target, prepend=-1)).tolist()
            for low, high in zip(cuts, [*cuts[1:], batch.num_rows]):
                slot[low:high] = slots(int(target[low]))[arrival[low:high]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(shard[target], pa.int32()), pa.array(slot, pa.int64())], schema)

    return run


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``df`` in a uniformly random order over ``shards`` shards whose sizes differ by one at most.

    Adds ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard);
    columns of these names are replaced, all others pass through, whatever their names
    and values: nulls, ties and repeated rows are rows like any other.  Fewer rows than
    shards leave the last shards empty; an empty table stays empty.

    The same rows in the same partitions give the same order for a seed.  The input is
    checkpointed first, so that partitions keep their rows if tasks are run again.  A
    task holds its partition's numbers (24 bytes a row, not the rows), then one bin of
    ``bin_rows``; the driver holds one count a partition.
    """
    fields = [f for f in df.schema if f.name not in ("shard", "slot")]
    inner = checkpointed(df.select(*[quoted(f.name).alias(f"c{i}") for i, f in enumerate(fields)]))
    partitions = inner.rdd.getNumPartitions()
    counted = inner.groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = np.zeros(partitions, dtype=np.int64)
    for r in counted:
        sizes[r["p"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    shard, first, bins = bins_of(shard_sizes(int(before[-1]), shards), bin_rows)
    kept = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(fields)]
    dealt = T.StructType([*kept, T.StructField("bin", T.LongType()), T.StructField("arrival", T.LongType())])
    slotted = T.StructType([*kept, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    rows = inner.mapInArrow(_dealt(before, bins, seed, dealt.names), dealt)
    placed = rows.repartition("bin").sortWithinPartitions("bin")
    return placed.mapInArrow(_slotted(shard, first, bins, seed, slotted.names), slotted).toDF(*[f.name for f in fields], "shard", "slot")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = BIN_ROWS) -> None:
    """The shards as Parquet folders ``shard=N``, their files in order of ``slot``.

    A shard is written by as many tasks as it has stretches of ``rows_per_file`` slots.
    """
    stretch = F.floor(F.col("slot") / rows_per_file)
    sharded.repartition("shard", stretch).sortWithinPartitions("shard", "slot").write.option(
        "maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
