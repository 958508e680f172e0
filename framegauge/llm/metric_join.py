"""Exact metric range join of vectors: pivots, boundary replication, independent cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegauge.llm.components import connected_components, spanning_edges
from framegauge.session import checkpointed

# Vectors a pivot is chosen for, the most pivots of one group, and the rows of a cell
# that one task compares with each other.
CELL_ROWS = 4096
MAX_PIVOTS = 64
BLOCK_ROWS = 2048
# Rounding of angles; a wider boundary only replicates more.
SLACK = 1e-7


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, at least one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def assign_cells(angle: np.ndarray, radius: float) -> list[tuple[np.ndarray, int, bool]]:
    """(rows, cell, home) of vectors with the given angles to the pivots.

    A vector's home is its nearest pivot.  If y of home j lies within ``radius`` of x
    of home i, the triangle inequality gives angle(x, j) <= radius + angle(y, j) <=
    radius + angle(y, i) <= 2 radius + angle(x, i).  Replicas only go to cells of a
    higher number, so every pair of two homes meets in one cell.
    """
    home = angle.argmin(axis=1)
    reach = angle[np.arange(len(angle)), home] + 2 * radius + SLACK
    placed = []
    for cell in range(angle.shape[1]):
        placed.append((np.flatnonzero(home == cell), cell, True))
        placed.append((np.flatnonzero((home < cell) & (angle[:, cell] <= reach)), cell, False))
    return [p for p in placed if len(p[0])]


def block_links(block: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Links within one pair of blocks: per vector the rows it is linked to, and the
    smallest vector it hangs together with.  Pairs that meet in another task as well
    (both replicas, or in one block of a pair of two) are left to it."""
    block = block.sort_values("rep", kind="stable", ignore_index=True)
    vectors = units(block["vector"])
    home = block["home"].to_numpy()
    part = block["part"].to_numpy()
    weight = block["copies"].to_numpy()
    split = block["low"].iloc[0] != block["high"].iloc[0]
    near = np.zeros((len(block), len(block)), dtype=bool)
    for at in range(0, len(block), 256):
        rows = slice(at, at + 256)
        near[rows] = vectors[rows] @ vectors.T >= min_cosine
        near[rows] &= home[rows, None] | home[None, :]
        if split:
            near[rows] &= part[rows, None] != part[None, :]
    np.fill_diagonal(near, False)
    near |= near.T
    links = near @ weight
    ids = block["rep"].to_numpy()
    root = ids.copy()
    for i, j in spanning_edges(lambda i: np.flatnonzero(near[i]).tolist(), range(len(block))):
        root[i] = ids[j]
    found = links > 0
    return pd.DataFrame({"rep": ids[found], "links": links[found].astype(np.int64), "root": root[found]})


def metric_range_join(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label",
                      min_cosine: float = 0.98, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with integer ids.

    Two rows are linked if their groups are equal and not null and the cosine of their
    vectors in double precision is at least ``min_cosine``.  n_links counts the other
    rows linked directly, component_id is the smallest id that can be reached, kept
    says that it is the row's own.  Null, empty, zero and non-finite vectors, vectors
    of another length than their partners and rows without id link with nothing (a
    null id has a null component_id and is kept).  Other columns are ignored.

    Equal vectors of a group are one vertex with a number of copies.  Groups above
    ``cell_rows`` get pivots (at most 64, the bound of what is replicated to place a
    vector).  A cell of any size is cut into blocks that meet pair by pair, a task
    holding two blocks; it returns counts and a spanning forest, never the pairs.
    Random directions cannot be separated by any metric partition: there the boundary
    takes in much of every cell, and the work grows with the square of a group.
    """
    radius = math.acos(min_cosine)
    valid = usable(F.col("vector")) & F.col("vec_id").isNotNull() & F.col("group").isNotNull()
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("vector"),
        F.concat_ws("/", F.col(f"`{group}`").cast("string"), F.size(f"`{vector}`").cast("string")).alias("size_group"),
        F.col(f"`{group}`").alias("group"))
    # 128 bits stand for the vector where classes are joined back.
    keyed = rows.select("vec_id", "vector", F.when(valid, F.col("size_group")).alias("group"), F.xxhash64("vector").alias("h1"),
                        F.xxhash64(F.lit(1), "vector").alias("h2"))
    classes = checkpointed(keyed.where("group is not null").groupBy("group", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")))

    sizes = classes.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts"))
    sizes = checkpointed(sizes)
    ranked = classes.select("group", "rep", "vector", F.row_number().over(
        Window.partitionBy("group").orderBy(F.xxhash64("rep"), "rep")).alias("rank")).where(F.col("rank") <= MAX_PIVOTS)
    pivots = ranked.join(sizes, "group").where((F.col("rank") <= F.col("parts")) & (F.col("parts") > 1))
    pivots = pivots.select(F.col("group").alias("of"), "rank", F.col("vector").alias("pivot"),
                           F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"))
    placed = classes.join(sizes, "group").select(
        "group", "rep", "copies", "vector", "parts", F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("parts")).cast("int").alias("part"))
    single = placed.where("parts = 1").select("group", F.lit(0).alias("cell"), F.lit(True).alias("home"), "rep", "copies", "vector")

    def assign(some: pd.DataFrame, pivot: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return pd.DataFrame({"group": [], "cell": [], "home": [], "rep": [], "copies": [], "vector": []})
        pivot = pivot.sort_values("rank")
        angle = angles(units(some["vector"]), units(pivot["pivot"]))
        made = []
        for at, cell, home in assign_cells(angle, radius):
            made.append(some.iloc[at][["group", "rep", "copies", "vector"]].assign(cell=cell, home=home))
        return pd.concat(made)[["group", "cell", "home", "rep", "copies", "vector"]]

    kind = classes.schema["vector"].dataType.simpleString()
    cells = placed.where("parts > 1").groupBy("group", "part").cogroup(pivots.groupBy("of", "of_part")).applyInPandas(
        assign, f"group string, cell int, home boolean, rep bigint, copies bigint, vector {kind}")
    cells = checkpointed(single.unionByName(cells))

    blocks = checkpointed(cells.groupBy("group", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")))
    spread = cells.join(blocks, ["group", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int"))
    meeting = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", "cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        "home", "part", "rep", "copies", "vector")
    found = checkpointed(meeting.groupBy("group", "cell", "low", "high").applyInPandas(
        lambda block: block_links(block, min_cosine), "rep bigint, links bigint, root bigint"))

    components = connected_components(found.select("rep", "root"), "rep", "root")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("group", "h1", "h2", "rep", "copies").join(counts, "rep", "left").join(
        components, F.col("rep") == F.col("node"), "left")
    known = checkpointed(known.select(
        "group", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id")))
    return keyed.drop("vector").join(known, ["group", "h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
