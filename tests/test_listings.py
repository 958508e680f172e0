import re

import pytest
from pyspark.sql import functions as F

from framegauge.operators import registry as rg
from framegauge.operators.name_index import build_name_index
from framegauge.operators.rank_directory import build_rank_directory
from framegauge.session import scratch_path


@pytest.fixture(scope="module")
def datasets(spark):
    """Two thirds of the rows belong to owner 0, some to nobody; sizes repeat and have gaps."""
    i = F.col("id")
    return spark.range(2000).select(
        "id", F.when(i % 3 < 2, 0).when(i % 31 > 0, 1 + i % 5).alias("owner_id"),
        F.when(i % 7 > 0, i * 7919 % 97).alias("rows"),
        F.when(i % 11 > 0, F.concat(F.element_at(F.array(*[F.lit(n) for n in ("Sales_", "stock%", "a\\b", "Übersicht ", "x")]), (i % 5 + 1).cast("int")),
                                    (i * 31 % 400).cast("string"))).alias("original_filename"),
        (i % 2).alias("place2"))


def parts_read(df):
    """How many parts the scan of a plan is held to."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    picked = re.search(r"PartitionFilters: \[.*?_part#\d+L? (?:IN \(([\d,]+)\)|= (\d+))", plan)
    return len((picked[1] or picked[2]).split(","))


def pairs(df):
    return sorted((r["owner_id"] is not None, r["owner_id"], r["place"], r["id"]) for r in df.collect())


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_of_a_listing_read_their_parts(spark, datasets, order):
    listing = build_rank_directory(datasets, scratch_path(spark, "listing"), "rows", order, per_owner=False, part_rows=150)
    want = [r["id"] for r in rg.sort_datasets(datasets, "rows", order).collect()]
    for page in (1, 9, 53, 80):
        got = listing.page(page, 25)
        assert [r["id"] for r in got.collect()] == want[25 * (page - 1):25 * page]
        assert [r["place"] for r in got.collect()] == list(range(25 * (page - 1) + 1, 25 * page + 1))
        assert parts_read(got) <= 2 < len(listing.rows.inputFiles())
    assert listing.page(81, 25).collect() == []
    assert set(listing.page(81, 25).columns) == set(listing.page(1, 25).columns) == {*datasets.columns, "place"}
    with pytest.raises(ValueError):
        listing.page(0, 25)
    with pytest.raises(ValueError):
        listing.page(1, 25, owner=1)


def test_pages_by_owner(spark, datasets):
    listing = build_rank_directory(datasets, scratch_path(spark, "listing"), "rows", part_rows=150)
    for page, size in ((1, 3), (2, 40), (30, 40), (2000, 1)):
        assert pairs(listing.page_per_owner(page, size)) == pairs(rg.page_per_owner(datasets, page, size, "rows"))
        want = [r["id"] for r in rg.page_datasets(datasets.where("owner_id = 0"), page, size, "rows").collect()]
        assert [r["id"] for r in listing.page(page, size, owner=0).collect()] == want
    assert listing.page(1, 5, owner=99).collect() == []
    # A page of the owner with most rows leaves out the parts before it.
    assert parts_read(listing.page(30, 40, owner=0)) <= 2
    with pytest.raises(ValueError):
        listing.page(1, 5)


def test_listing_of_nothing(spark, datasets):
    listing = build_rank_directory(datasets.where("id < 0"), scratch_path(spark, "listing"), "rows")
    assert listing.page(1, 5, owner=0).count() == listing.page_per_owner(1, 5).count() == 0


@pytest.mark.parametrize("search", ["sales_1", "SALES_395", "ock%1", "stock_2", "%ersicht 3", "ÜBER", "a\\b12", "b1", "x", "", None,
                                    "nowhere", "les%39%", "ale_1__", "s_1"])
def test_search_by_trigrams_finds_what_the_scan_finds(indexed, datasets, search):
    got, want = indexed.search(search), rg.search_datasets(datasets, search)
    assert got.columns == want.columns
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


@pytest.fixture(scope="module")
def indexed(spark, datasets):
    return build_name_index(datasets, scratch_path(spark, "names"), part_rows=100)


def test_a_rare_name_reads_few_parts(spark, indexed, datasets):
    found = indexed.search("sales_395")
    assert 0 < found.count() == rg.search_datasets(datasets, "sales_395").count()
    assert parts_read(found) <= found.count() < len(indexed.rows.inputFiles())
    nothing = build_name_index(datasets.where("id < 0"), scratch_path(spark, "names"))
    assert nothing.search("sales").count() == nothing.search("s").count() == 0


def test_repeated_ids_are_all_found(spark):
    df = spark.createDataFrame([(1, "abcd"), (1, "cdef"), (1, "abcd"), (None, "abcd"), (2, None)], "id bigint, original_filename string")
    assert build_name_index(df, scratch_path(spark, "names")).search("bcd").count() == 3
