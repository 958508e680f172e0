"""Pearson correlation of every pair of numeric columns.

Each pair uses the rows in which both values are present.  Pairs are laid out in
batches; one Expand emits a row per batch, and one aggregate with a fixed number
of slots serves all of them, narrow enough for code generation.  Where neither
column has a missing value the pair needs its covariance only.

An Expand grows with the pairs, that is with the square of the columns.  Tables of
many columns are summed up as matrix products instead: every task multiplies its
batches, and one row per pair and task is added up.  By group, the rows of a group that
has many in every task are summed up where they are read, so that only moments of its
pairs are shuffled.  The rows of the others meet by group: a task takes one share of a
group's rows at a time and returns the moments of its pairs, and only groups of several
shares have moments to combine.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.functions.columns import NUMERIC_KINDS, columns_of_kind, normalize_missing, quoted
from framegauge.operators.cells import key_names, keys_aliased, keys_restored
from framegauge.operators.joins import BROADCAST_ROWS, count_up_to, keyed_join, null_safe_join
from framegauge.session import checkpointed

# Columns from which on a table's pairs are summed up as matrix products.
MATRIX_COLUMNS = 33
# Values of one share of a group's rows, of which a task holds one at a time.
SHARE_VALUES = 8_000_000
# Bytes of a pair's moments, and of those that a task holds before it hands them on.
MOMENT_BYTES = 64
HELD_BYTES = 32 << 20
# Groups that are summed up where their rows are read.
READ_GROUPS = 10_000
PLAIN_PAIRS_PER_BATCH = 8
MASKED_PAIRS_PER_BATCH = 4

Pair = tuple[int, int]


def _complete(df: DataFrame, columns: list[str]) -> set[int]:
    """Positions of the columns without missing values, from one aggregate."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"),
                    *[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {i for i in range(len(columns)) if counts[f"c{i}"] == counts["rows"]}


def _pair_moments(wide: DataFrame, group: list[str], pairs: list[Pair], per_batch: int, masked: bool) -> DataFrame:
    """(group, x, y, sxy, sxx, syy) by column position; only sxy unless masked."""
    slots = min(per_batch, len(pairs))
    batches = [pairs[i:i + slots] for i in range(0, len(pairs), slots)]
    values = ", ".join(f"a{s}, b{s}" for s in range(slots))
    picks = ", ".join(
        "(" + ", ".join([f"x{a}, x{b}" for a, b in batch] + ["none, none"] * (slots - len(batch))) + f") AS `{n}`"
        for n, batch in enumerate(batches))
    expanded = wide.sparkSession.sql(
        f"SELECT * FROM {{wide}} UNPIVOT INCLUDE NULLS (({values}) FOR batch IN ({picks}))", wide=wide
    ).withColumn("batch", F.col("batch").cast("int"))

    aggs = []
    for s in range(slots):
        a, b = F.col(f"a{s}"), F.col(f"b{s}")
        if masked:
            aggs += [F.regr_sxy(b, a).alias(f"sxy{s}"), F.regr_sxx(b, a).alias(f"sxx{s}"),
                     F.regr_syy(b, a).alias(f"syy{s}")]
        else:
            aggs.append(F.covar_samp(a, b).alias(f"sxy{s}"))

    def slot(s: int) -> Column:
        pair = F.get(F.array(*[F.struct(F.lit(b[s][0]).alias("x"), F.lit(b[s][1]).alias("y"))
                               for b in batches if s < len(b)]), F.col("batch"))
        sums = ("sxy", "sxx", "syy") if masked else ("sxy",)
        return F.struct(pair["x"].alias("x"), pair["y"].alias("y"), *[F.col(f"{m}{s}").alias(m) for m in sums])

    return (expanded.groupBy(*group, "batch").agg(*aggs)
            .select(*group, F.inline(F.array(*[slot(s) for s in range(slots)])))
            .where(F.col("x").isNotNull()))


MOMENTS = ("n", "mean_x", "mean_y", "sxx", "syy", "sxy")


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "endless")


def matrix_correlations(wide: DataFrame, columns: int) -> DataFrame:
    """(x, y, corr) by column position for x at or before y, from columns x0, x1, ... of doubles.

    Values are taken relative to their column's mean, so that large ones cancel
    nothing out; a variance that is rounding only counts as none.  A pair that meets an
    infinity is undefined.
    """
    names = [f"x{i}" for i in range(columns)]
    finite = [F.when(F.abs(c) < float("inf"), F.col(c)) for c in names]
    found = wide.agg(*[F.avg(c).alias(n) for c, n in zip(finite, names)]).first()
    means = np.array([found[n] or 0.0 for n in names])
    low, high = np.triu_indices(columns)

    def run(batches):
        sums = None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                rows = batch.slice(start, 4096)
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in rows.columns]) - means
                there = ~np.isnan(values)
                x, m, e = np.where(np.isfinite(values), values, 0.0), there.astype(float), np.isinf(values).astype(float)
                new = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x, e.T @ m + m.T @ e])
                sums = new if sums is None else sums + new
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), *[pa.array(s[low, high]) for s in sums]], ["x", "y", *SUMS])

    parts = wide.select(*names).mapInArrow(run, "x int, y int, " + ", ".join(f"{s} double" for s in SUMS))
    total = parts.groupBy("x", "y").agg(*[F.sum(s).alias(s) for s in SUMS])

    def spread(square: str, plain: str) -> Column:
        rest = F.col(square) - F.col(plain) * F.col(plain) / F.col("n")
        return F.when(rest > F.col(square) * 1e-12, rest)

    shared = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"))
    both = total.where("n > 1 and endless = 0").select("x", "y", _as_corr(F.when(
        F.col("x") == F.col("y"), F.when(spread("sxx", "sx") < float("inf"), 1.0)).otherwise(
        shared / F.sqrt(spread("sxx", "sx")) / F.sqrt(spread("syy", "sy")))))
    pairs = wide.sparkSession.createDataFrame(pa.table({"x": low.astype(np.int32), "y": high.astype(np.int32)}))
    return pairs.join(both, ["x", "y"], "left").select("x", "y", F.coalesce("corr", F.lit(0.0)).alias("corr"))


def _share_moments(values: np.ndarray) -> list[np.ndarray]:
    """``MOMENTS`` of every pair of columns, over the rows that have both values.

    Values are taken relative to their column's mean; what is rounding only counts as no
    deviation.  A pair that meets an infinity has NaN.
    """
    low, high = np.triu_indices(values.shape[1])
    finite = np.isfinite(values)
    there, endless = (~np.isnan(values)).astype(float), np.isinf(values).astype(float)
    known = np.where(finite, values, 0.0)
    centre = known.sum(axis=0) / np.maximum(finite.sum(axis=0), 1)
    x = np.where(finite, values - centre, 0.0)
    met = endless.T @ there
    n, sx, square, product = there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
    rows = np.maximum(n, 1)

    def spread(squares: np.ndarray, sums: np.ndarray) -> np.ndarray:
        rest = squares - sums * sums / rows
        return np.where(rest > squares * 1e-12, rest, 0.0)

    found = [n, centre[:, None] + sx / rows, centre[None, :] + sx.T / rows, spread(square, sx), spread(square.T, sx.T),
             product - sx * sx.T / rows]
    undefined = met + met.T > 0
    return [np.where(undefined & (i >= 3), np.nan, m)[low, high] for i, m in enumerate(found)]


def _joined_moments(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """``MOMENTS`` of disjoint rows put together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    moved = a[0] * share
    # Where one side has no rows of a pair, the other's means stay as they are.
    both = a[0] > 0
    return [n, np.where(both, a[1] + dx * share, b[1]), np.where(both, a[2] + dy * share, b[2]),
            a[3] + b[3] + dx * dx * moved, a[4] + b[4] + dy * dy * moved, a[5] + b[5] + dx * dy * moved]


def _read_moments(rows: DataFrame, columns: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(number, x, y, moments) from columns number, x0, x1, ...: one row per pair, group and task, or a few."""
    names = [f"x{i}" for i in range(columns)]
    low, high = (i.astype(np.int32) for i in np.triu_indices(columns))
    most = max(1, held_bytes // (MOMENT_BYTES * len(low)))

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}

        def handed_on():
            for number, sums in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(low), number, np.int64)), pa.array(low), pa.array(high), *[pa.array(m) for m in sums]],
                    ["number", "x", "y", *MOMENTS])
            held.clear()

        for batch in batches:
            numbers = batch.column("number").to_numpy()
            order = np.argsort(numbers, kind="stable")
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])[order]
            found, starts = np.unique(numbers[order], return_index=True)
            for number, start, end in zip(found.tolist(), starts, [*starts[1:], len(order)]):
                if number not in held and len(held) == most:
                    yield from handed_on()
                sums = _share_moments(values[start:end])
                held[number] = _joined_moments(held[number], sums) if number in held else sums
        yield from handed_on()

    return rows.select("number", *names).mapInArrow(run, "number bigint, x int, y int, " + ", ".join(f"{m} double" for m in MOMENTS))


def grouped_matrix_moments(wide: DataFrame, group: list[str], columns: int, share_values: int = SHARE_VALUES) -> DataFrame:
    """(group, x, y, n, mean_x, mean_y, sxx, syy, sxy) by column position for x at or before y.

    A group whose moments take less room than its rows, from every partition it is read
    in, is summed up there.  The rows of the others are shuffled by group, cut into shares
    of about ``share_values`` values by the input partitions, so a hot one takes many tasks.
    Parts of a group are combined by moving their deviations to the common means.
    """
    names = [f"x{i}" for i in range(columns)]
    share_rows = max(1, share_values // columns)
    shares = F.ceil(F.col("rows") / share_rows).cast("int")
    # The place a row is read at is the same when a lost task runs again.
    placed = wide.select(*group, *names, F.spark_partition_id().alias("placed"))
    sizes = (placed.groupBy(*group, "placed").agg(F.count(F.lit(1)).alias("rows"))
             .groupBy(*group).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("parts")))
    # A row has 8 bytes a column, the moments have MOMENT_BYTES a pair.
    worth = F.col("rows") > F.col("parts") * (MOMENT_BYTES * (columns + 1) // 16)
    hot = checkpointed(sizes.where(worth | (F.col("rows") > share_rows)).select(
        *group, "rows", shares.alias("shares"), worth.alias("worth")))
    read = checkpointed(hot.where("worth").orderBy(F.desc("rows")).limit(READ_GROUPS).select(
        *group, "rows", F.monotonically_increasing_id().alias("number")))
    found = read.agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows")).first()
    parts = []
    if found["groups"]:
        numbered = keyed_join(placed, read.select(*group, "number"), group, "left", found["groups"])
        sums = _read_moments(numbered.where("number IS NOT NULL"), columns)
        parts.append(merged_moments(checkpointed(sums), ["number", "x", "y"]).join(
            read.select(*group, "number"), "number").select(*group, "x", "y", *MOMENTS))
        if wide.count() == found["rows"]:
            return parts[0]
        placed = numbered.where("number IS NULL").drop("number")
        hot = keyed_join(hot, read.select(*group), group, "left_anti", found["groups"])
    hot = checkpointed(hot.where(F.col("rows") > share_rows).select(*group, "shares"))
    parts.append(_shared_moments(placed, group, columns, hot, count_up_to(hot, BROADCAST_ROWS)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _shared_moments(placed: DataFrame, group: list[str], columns: int, hot: DataFrame, hot_groups: int) -> DataFrame:
    """Moments of groups whose rows are shuffled; ``hot`` has the shares of the large ones."""
    names = [f"x{i}" for i in range(columns)]
    if hot_groups:
        placed = keyed_join(placed, hot, group, "left", hot_groups)
    else:
        placed = placed.withColumn("shares", F.lit(1))
    shared = placed.withColumn("share", F.pmod("placed", F.coalesce("shares", F.lit(1)))).drop("placed", "shares")
    low, high = (i.astype(np.int32) for i in np.triu_indices(columns))

    def moments(rows: pa.Table) -> pa.Table:
        sums = _share_moments(np.column_stack([rows.column(c).to_numpy() for c in names]))
        keys = rows.select(group).take(pa.array(np.zeros(len(low), np.int64)))
        return pa.Table.from_arrays([*keys.columns, pa.array(low), pa.array(high), *[pa.array(s) for s in sums]],
                                    [*group, "x", "y", *MOMENTS])

    kinds = placed.schema
    schema = ", ".join([f"{g} {kinds[g].dataType.simpleString()}" for g in group] + ["x int, y int"]
                       + [f"{m} double" for m in MOMENTS])
    parts = shared.groupBy(*group, "share").applyInArrow(moments, schema)
    return merged_moments(checkpointed(parts), [*group, "x", "y"]) if hot_groups else parts


def merged_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Moments of disjoint rows put together; ``parts`` are read twice."""
    def mean(value: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col("n")), F.sum("n")), F.lit(0.0))

    whole = parts.groupBy(*by).agg(F.sum("n").alias("n"), mean("mean_x").alias("mean_x"), mean("mean_y").alias("mean_y"))
    own = parts.withColumnsRenamed({"mean_x": "own_x", "mean_y": "own_y"})
    dx, dy = F.col("own_x") - F.col("mean_x"), F.col("own_y") - F.col("mean_y")
    moved = null_safe_join(own, whole.drop("n"), by, "inner").groupBy(*by).agg(*[
        F.sum(F.col(m) + F.col("n") * shift).alias(m) for m, shift in (("sxx", dx * dx), ("syy", dy * dy), ("sxy", dx * dy))])
    return null_safe_join(whole, moved, by, "inner").select(*by, *MOMENTS)


def grouped_matrix_correlations(wide: DataFrame, group: list[str], columns: int, share_values: int = SHARE_VALUES) -> DataFrame:
    """(group, x, y, corr) by column position for x at or before y; undefined is 0."""
    def spread(square: str, mean: str) -> Column:
        # Means of a constant column's shares differ by rounding.
        rest = F.col(square)
        return F.when(rest > F.col("n") * F.pow(F.col(mean) * 1e-13, F.lit(2)), rest)

    sxx, syy = spread("sxx", "mean_x"), spread("syy", "mean_y")
    corr = F.when(F.col("x") == F.col("y"), F.when(sxx < float("inf"), 1.0)).otherwise(
        F.try_divide(F.try_divide(F.col("sxy"), F.sqrt(sxx)), F.sqrt(syy)))
    return grouped_matrix_moments(wide, group, columns, share_values).select(*group, "x", "y", _as_corr(corr))


def _as_corr(r: Column) -> Column:
    # Infinities leave NaN sums behind, which is undefined like a constant column.
    return F.round(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)), 3).alias("corr")


def pair_correlations(df: DataFrame, keys: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame | None:
    """(keys, x, y, corr) for x at or before y in column order; None below two columns.

    ``counts`` are column counts of the table, where they are known already: they say
    which columns are complete and how far they deviate, and two scans are saved.  A constant column has no correlation, not even with itself; ``corr`` would
    divide by zero there and fail the whole aggregate.
    """
    df = normalize_missing(df)
    columns = columns_of_kind(df, *NUMERIC_KINDS, skip=keys)
    if len(columns) < 2:
        return None
    group = key_names(keys)
    wide = df.select(*keys_aliased(keys),
                     *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
                     F.lit(None).cast("double").alias("none"))
    names = F.array(*[F.lit(c) for c in columns])
    if not keys and len(columns) >= MATRIX_COLUMNS:
        return matrix_correlations(wide, len(columns)).select(
            F.get(names, F.col("x")).alias("x"), F.get(names, F.col("y")).alias("y"), "corr")
    if len(columns) >= MATRIX_COLUMNS:
        return grouped_matrix_correlations(wide, group, len(columns)).select(
            *keys_restored(keys), F.get(names, F.col("x")).alias("x"), F.get(names, F.col("y")).alias("y"), "corr")
    complete = _complete(df, columns) if counts is None else {columns.index(r[0]) for r in counts.where(
        F.col("column").isin(columns)).groupBy("column").agg(F.sum("missing").alias("m")).where("m = 0").collect()}
    pairs = list(combinations(range(len(columns)), 2))
    plain = [p for p in pairs if complete.issuperset(p)]
    masked = [p for p in pairs if not complete.issuperset(p)]

    # Both frames have a row per (group, column) only.
    if counts is None:
        deviations = wide.groupBy(*group).agg(
            *[F.stddev_samp(f"x{i}").alias(f"s{i}") for i in range(len(columns))]
        ).select(*group, F.inline(F.array(*[
            F.struct(F.lit(i).alias("x"), F.col(f"s{i}").alias("sx")) for i in range(len(columns))])))
    else:
        place = (F.array_position(names, F.col("column")) - 1).cast("int")
        deviations = counts.where(F.col("column").isin(columns)).select(*keys_aliased(keys), place.alias("x"), F.col("std").alias("sx"))
    result = deviations.select(*group, "x", F.col("x").alias("y"),
                               F.when((F.col("sx") > 0) & ~F.isnan("sx"), 1.0).otherwise(0.0).alias("corr"))
    if plain:
        sums = _pair_moments(wide, group, plain, PLAIN_PAIRS_PER_BATCH, masked=False)
        both = null_safe_join(null_safe_join(sums, deviations, group + ["x"], "inner"),
                              deviations.withColumnsRenamed({"x": "y", "sx": "sy"}), group + ["y"], "inner")
        result = result.unionByName(both.select(
            *group, "x", "y", _as_corr(F.try_divide(F.col("sxy"), F.col("sx") * F.col("sy")))))
    if masked:
        sums = _pair_moments(wide, group, masked, MASKED_PAIRS_PER_BATCH, masked=True)
        result = result.unionByName(sums.select(
            *group, "x", "y", _as_corr(F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")))))
    return result.select(*keys_restored(keys), F.get(names, F.col("x")).alias("x"),
                         F.get(names, F.col("y")).alias("y"), "corr")


def correlation_matrix(df: DataFrame, keys: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, corr) for every ordered pair; undefined is 0, no rows below two columns."""
    pairs = pair_correlations(df, keys, counts)
    if pairs is None:
        schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
                           + ["x string, y string, corr double"])
        return df.sparkSession.createDataFrame([], schema)
    one = F.array(F.struct("x", "y"))
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return (pairs.withColumn("sides", F.when(F.col("x") == F.col("y"), one).otherwise(both))
            .select(*[quoted(k) for k in keys], F.inline("sides"), "corr"))
