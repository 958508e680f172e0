"""Trigram index over the names of a registry: a search reads the parts that can match.

Postings say which ids, in which part of the written rows, have each three letters in
their lower-cased name.  A search takes the rarest trigrams of its literal stretches,
intersects their postings, reads the parts that are left and verifies every row with the
search itself, so the rows are those of the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framegauge.operators.joins import BROADCAST_ROWS, count_up_to, keyed_join
from framegauge.operators.registry import search_datasets
from framegauge.session import checkpointed
from framegauge.sources.part_files import read_parts, write_parts

GRAM = 3
PART_ROWS = 100_000
PART = "name_part"
# Trigrams of a search whose postings are intersected, the rarest first.
RAREST = 4
# A search whose rarest trigram is in more than this share of the names scans.
SCAN_SHARE = 0.25


def trigrams(name: Column) -> Column:
    """Distinct three-letter pieces of the lower-cased name; none below three letters."""
    lower = F.lower(name)
    starts = F.sequence(F.lit(1), F.length(lower) - (GRAM - 1))
    return F.when(F.length(lower) >= GRAM, F.array_distinct(F.transform(starts, lambda i: lower.substr(i, F.lit(GRAM)))))


class NameIndex:
    """A written index: ``rows`` by part, ``postings`` of (gram, name_part, id), ``grams`` of (gram, n)."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = read_parts(spark, path)
        self.postings, self.grams = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "grams"))

    def _rarest(self, search: str) -> list[str] | None:
        """The trigrams to look up; None where a scan is as good, [] where nothing can match."""
        spark = self.rows.sparkSession
        lower = spark.range(1).select(F.lower(F.lit(search))).first()[0]
        stretches = re.split("[%_]", lower)
        wanted = {s[i:i + GRAM] for s in stretches for i in range(len(s) - GRAM + 1)}
        if not wanted:
            return None
        known = {r["gram"]: r["n"] for r in self.grams.where(F.col("gram").isin(sorted(wanted))).collect()}
        if len(known) < len(wanted):
            return []
        rarest = sorted(wanted, key=lambda g: (known[g], g))[:RAREST]
        return None if known[rarest[0]] > SCAN_SHARE * self.rows.count() else rarest

    def search(self, search: str | None) -> DataFrame:
        """The rows that ``search_datasets`` finds, % and _ being wildcards there and here.

        Searches without three literal letters in a row, or of letters that most names
        have, scan.  At most a number a part is collected.
        """
        found = self._rarest(search) if search else None
        if found is None:
            return search_datasets(self.rows, search).drop(PART)
        if not found:
            return self.rows.where(F.lit(False)).drop(PART)
        listed = self.postings.where(F.col("gram").isin(found)).groupBy(PART, "id").agg(
            *[F.max(F.col("gram") == g).alias(f"has{i}") for i, g in enumerate(found)])
        for i in range(len(found)):
            listed = listed.where(f"has{i}")
        candidates = checkpointed(listed.select(PART, "id"))
        parts = sorted(r[0] for r in candidates.select(PART).distinct().collect())
        near = keyed_join(self.rows.where(F.col(PART).isin(parts)), candidates, [PART, "id"], "left_semi",
                          count_up_to(candidates, BROADCAST_ROWS))
        return search_datasets(near, search).drop(PART)


def build_name_index(datasets: DataFrame, path: str, part_rows: int = PART_ROWS) -> NameIndex:
    """Write ``datasets`` in parts by id, and the index of their names, to ``path``.

    Rows without a name are never found by letters; ids need not be unique.
    """
    spark = datasets.sparkSession
    write_parts(datasets, [F.asc("id")], PART, part_rows, path)
    rows = read_parts(spark, path)
    # In order of trigrams, so that a search reads the row groups of its own ones.
    postings = rows.select(F.explode(trigrams(F.col("original_filename"))).alias("gram"), PART, "id")
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", PART, "id").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/grams")
    return NameIndex(spark, path)
