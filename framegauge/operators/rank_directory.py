"""Listings laid out in sort order, so that a page however deep reads one or two parts.

The rows are cut into parts by ranges of (owner, sort column, id) and written in that
order; the directory holds how many rows of an owner lie in each part and how many
before it.  A page looks up its parts there and ranks within them only: no skipped row
is read, sorted or sent anywhere.  One owner may hold any share of the rows, since ids
cut that owner's rows into parts, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framegauge.operators.joins import BROADCAST_ROWS, count_up_to, keyed_join
from framegauge.operators.registry import check_page, sort_order
from framegauge.sources.part_files import read_parts, write_parts

# Rows of a part, of which a page reads one or two.
PART_ROWS = 1_000_000
PART = "rank_part"


class RankDirectory:
    """A written listing: ``rows`` by part, ``entries`` of (owner_id, rank_part, n, before)."""

    def __init__(self, spark: SparkSession, path: str, sort_by: str = "uploaded_at", order: str = "desc"):
        self.rows = read_parts(spark, path)
        self.entries = spark.read.parquet(f"{path}/entries")
        self.by = sort_order(sort_by, order)
        self.owners = [c for c in ("owner_id",) if c in self.entries.columns]

    def _overlapping(self, page: int, page_size: int) -> DataFrame:
        check_page(page, page_size)
        return self.entries.where((F.col("before") < page * page_size) & (F.col("before") + F.col("n") > (page - 1) * page_size))

    def _placed(self, rows: DataFrame, before, page: int, page_size: int) -> DataFrame:
        within = Window.partitionBy(PART, *self.owners).orderBy(*self.by)
        return (rows.withColumn("place", (F.row_number().over(within) + before).cast("bigint"))
                .where((F.col("place") > (page - 1) * page_size) & (F.col("place") <= page * page_size))
                .drop(PART, "before"))

    def page(self, page: int = 1, page_size: int = 10, owner: int | None = None) -> DataFrame:
        """One page in order, with each row's ``place``: of one owner, or of a listing of all rows.

        A page beyond the end is empty.  At most one entry a part is collected.
        """
        if (owner is None) == bool(self.owners):
            raise ValueError("an owner is needed where the listing is by owner, and only there")
        found, rows = self._overlapping(page, page_size), self.rows
        if owner is not None:
            found, rows = found.where(F.col("owner_id") == owner), rows.where(F.col("owner_id") == owner)
        before = {r[PART]: r["before"] for r in found.select(PART, "before").collect()}
        if not before:
            return rows.where(F.lit(False)).withColumn("place", F.lit(0).cast("bigint")).drop(PART)
        skipped = F.create_map(*[F.lit(v) for pair in sorted(before.items()) for v in pair])[F.col(PART)]
        return self._placed(rows.where(F.col(PART).isin(sorted(before))), skipped, page, page_size).orderBy("place")

    def page_per_owner(self, page: int = 1, page_size: int = 10) -> DataFrame:
        """The same page of every owner; rows of parts that hold none of it go before anything is ranked."""
        if not self.owners:
            raise ValueError("the listing is not by owner")
        found = self._overlapping(page, page_size).select("owner_id", PART, "before")
        rows = keyed_join(self.rows, found, ["owner_id", PART], "inner", count_up_to(found, BROADCAST_ROWS))
        return self._placed(rows, F.col("before"), page, page_size)


def build_rank_directory(
    datasets: DataFrame, path: str, sort_by: str = "uploaded_at", order: str = "desc", per_owner: bool = True,
    part_rows: int = PART_ROWS,
) -> RankDirectory:
    """Lay ``datasets`` out at ``path``, per owner or as one listing of all rows.

    Ids are unique.  Missing values sort as in ``sort_datasets``; rows without an owner
    are listed as those of a missing owner.
    """
    spark = datasets.sparkSession
    owners = ["owner_id"] if per_owner else []
    write_parts(datasets, [*[F.asc(c) for c in owners], *sort_order(sort_by, order)], PART, part_rows, path)
    counts = read_parts(spark, path).groupBy(*owners, PART).agg(F.count(F.lit(1)).alias("n"))
    # An owner, or the listing, has an entry a part at most.
    earlier = Window.partitionBy(*owners).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).write.parquet(f"{path}/entries")
    return RankDirectory(spark, path, sort_by, order)
