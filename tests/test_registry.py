from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framegauge.operators import registry as rg
from framegauge.plans.dashboard import dashboard, dashboards, owner_stats

DATASETS = ("id bigint, owner_id bigint, filename string, original_filename string, file_type string, file_path string, "
            "file_size bigint, rows bigint, columns int, uploaded_at timestamp_ntz")


def dataset(i, owner, name, when, kind="csv", rows=10):
    return (i, owner, f"{i}.dat", name, kind, f"/d/{i}", i * 100, rows, 3, when)


@pytest.fixture(scope="module")
def datasets(spark):
    return spark.createDataFrame([
        dataset(1, 1, "Ab_c", datetime(2023, 1, 5)), dataset(2, 1, "abXc", datetime(2024, 1, 9), "xls", 20),
        dataset(3, 1, "other", datetime(2024, 3, 1)), dataset(4, 2, "ab_c", datetime(2024, 3, 1)),
        dataset(5, 2, "b", datetime(2024, 3, 1), "XLS"), dataset(6, 3, "lonely", datetime(2022, 7, 1))], DATASETS)


@pytest.fixture(scope="module")
def analyses(spark):
    return spark.createDataFrame([
        (11, 1, 95, datetime(2024, 5, 1)), (12, 2, 80, datetime(2024, 5, 3)), (14, 4, 59, datetime(2024, 5, 2)),
        (15, 5, 60, datetime(2024, 5, 2))], "id bigint, dataset_id bigint, quality_score int, created_at timestamp_ntz")


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_scope_and_lookup(spark, datasets, analyses):
    assert set(ids(rg.owner_scope(datasets, 1))) == {1, 2, 3}
    owners = spark.createDataFrame([(2,), (3,), (2,)], "owner_id bigint")
    assert set(ids(rg.owner_scope(datasets, owners))) == {4, 5, 6}
    assert ids(rg.find_dataset(datasets, 1, 1)) == [1] and ids(rg.find_dataset(datasets, 1, 2)) == []
    keys = spark.createDataFrame([(1, 1), (4, 1), (6, 3)], "id bigint, owner_id bigint")
    assert set(ids(rg.dataset_lookup(datasets, keys))) == {1, 6}
    assert ids(rg.analysis_lookup(analyses, datasets, keys), "dataset_id") == [1]
    assert ids(rg.find_analysis(analyses, datasets, 4, 2)) == [14] and ids(rg.find_analysis(analyses, datasets, 4, 1)) == []


def test_totals(datasets, analyses):
    assert rg.total_datasets(datasets, 1).first()[0] == 3 and rg.total_datasets(datasets, 9).first()[0] == 0
    assert rg.total_rows(datasets, 1).first()[0] == 40 and rg.total_rows(datasets, 9).first()[0] == 0
    assert rg.total_analyses(datasets, analyses, 1).first()[0] == 2
    assert rg.average_quality(datasets, analyses, 1).first()[0] == 87.5
    assert rg.average_quality(datasets, analyses, 3).first()[0] == 0.0


def test_recent(datasets, analyses):
    rows = rg.recent_datasets(datasets, analyses, 1, k=2).orderBy("recent").collect()
    assert [(r["id"], r["quality_score"]) for r in rows] == [(3, None), (2, 80)]
    assert [r["id"] for r in rg.recent_datasets(datasets, analyses, 2).orderBy("recent").collect()] == [5, 4]
    assert [r["dataset_id"] for r in rg.recent_analyses(datasets, analyses, 1).orderBy("recent").collect()] == [2, 1]


def test_months_merge_years(datasets):
    assert [(r["month"], r["uploads"]) for r in rg.uploads_per_month(datasets, 1).collect()] == [("Jan", 2), ("Mar", 1)]


def test_file_types_are_upper_cased_after_grouping(spark):
    df = spark.createDataFrame([dataset(1, 1, "a", datetime(2024, 1, 1), "xls"), dataset(2, 1, "b", datetime(2024, 1, 1), "XLS")], DATASETS)
    assert [(r["file_type"], r["count"]) for r in rg.file_type_distribution(df, 1).collect()] == [("XLS", 1), ("XLS", 1)]


def test_score_ranges_are_always_five(datasets, analyses):
    found = rg.quality_distribution(datasets, analyses, 2).orderBy("position").collect()
    assert [(r["range"], r["count"]) for r in found] == [("90-100", 0), ("80-89", 0), ("70-79", 0), ("60-69", 1), ("<60", 1)]
    assert [r["count"] for r in rg.quality_distribution(datasets, analyses, 9).collect()] == [0] * 5


def test_search_wildcards(datasets):
    assert set(ids(rg.search_datasets(datasets, "B_C"))) == {1, 2, 4}
    assert rg.search_datasets(datasets, "").count() == rg.search_datasets(datasets, None).count() == 6


def test_sort(datasets):
    assert ids(rg.sort_datasets(datasets, "file_size", "Asc")) == [1, 2, 3, 4, 5, 6]
    assert ids(rg.sort_datasets(datasets, "no such column", "up")) == [5, 4, 3, 2, 1, 6]


def test_pages(datasets):
    items, meta = rg.list_datasets(datasets, 1, page=2, page_size=2)
    assert ids(items) == [1] and meta.first()[:] == (3, 2, 2, 2)
    empty, meta = rg.list_datasets(datasets, 9)
    assert ids(empty) == [] and meta.first()[:] == (0, 1, 10, 1)
    assert {(r["owner_id"], r["id"]) for r in rg.page_per_owner(datasets, 2, 1).collect()} == {(1, 2), (2, 4)}
    first = rg.page_datasets(datasets, 1, 2).collect()
    assert ids(rg.page_after(datasets, first[-1]["uploaded_at"], first[-1]["id"], 2)) == ids(rg.page_datasets(datasets, 2, 2))
    for bad in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            rg.list_datasets(datasets, 1, *bad)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_by_key_reach_every_row(spark, order):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4) for i in range(1, 12)], "id bigint, rows bigint")
    want, got, last = ids(rg.sort_datasets(df, "rows", order)), [], None
    while True:
        page = (rg.page_datasets(df, 1, 2, "rows", order) if last is None else
                rg.page_after(df, last["rows"], last["id"], 2, "rows", order)).collect()
        if not page:
            break
        got, last = got + [r["id"] for r in page], page[-1]
    assert got == want and len(got) == 11


def test_search_takes_a_backslash_as_it_is(spark):
    df = spark.createDataFrame([(1, "a\\b"), (2, "ab")], "id bigint, original_filename string")
    assert ids(rg.search_datasets(df, "a\\b")) == [1]


def test_deep_page_of_every_owner(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 < 2, 0).otherwise(1).alias("owner_id"), (F.col("id") * 7919 % 4001).alias("rows"))
    got = rg.page_per_owner(df, 12, 100, "rows").collect()
    pdf = df.toPandas().sort_values(["rows", "id"], ascending=False)
    want = {(o, i) for o, g in pdf.groupby("owner_id") for i in g["id"].iloc[1100:1200]}
    assert {(r["owner_id"], r["id"]) for r in got} == want and len(got) == 200


def test_rename_and_delete(spark, datasets, analyses):
    names = spark.createDataFrame([(1, 1, "new"), (2, 2, "not the owner"), (99, 1, "none")], "id bigint, owner_id bigint, new_name string")
    renamed = {r["id"]: r["original_filename"] for r in rg.rename_dataset(datasets, names).collect()}
    assert renamed[1] == "new" and renamed[2] == "abXc" and len(renamed) == 6
    left, kept = rg.delete_dataset(datasets, analyses, spark.createDataFrame([(1, 1), (1, 1), (6, 3), (2, 9)], "id bigint, owner_id bigint"))
    assert set(ids(left)) == {2, 3, 4, 5} and set(ids(kept, "dataset_id")) == {2, 4, 5}


def test_users(spark, datasets):
    users = spark.createDataFrame([(1, "Ann", "a@x"), (2, "Bo", "b@x")], "id bigint, full_name string, email string")
    found = {r["id"]: r["full_name"] for r in rg.user_lookup(datasets.select("id", "owner_id"), users, "id", "owner_id").collect()}
    assert found == {1: "Ann", 2: "Ann", 3: "Ann", 4: "Bo", 5: "Bo", 6: None}
    mails = spark.createDataFrame([("b@x",), ("z@x",)], "email string")
    assert {r["email"]: r["user_id"] for r in rg.user_lookup(mails, users).collect()} == {"b@x": 2, "z@x": None}
    candidates = spark.createDataFrame([(1, "a@x"), (2, "n@x"), (3, "n@x"), (4, "m@x")], "id bigint, email string")
    assert {r["id"]: r["accepted"] for r in rg.new_user_check(candidates, users).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_user_datasets(datasets):
    assert ids(rg.user_datasets(datasets, 1)) == [3, 2, 1]


def test_dashboard_of_all_owners_sums_up(datasets, analyses):
    stats = owner_stats(datasets, analyses)
    assert stats.agg(F.sum("total_datasets"), F.sum("total_analyses"), F.sum("total_rows")).first()[:] == (6, 4, 70)
    nested = {r["owner_id"]: r for r in dashboards(datasets, analyses).collect()}
    sections = dashboard(datasets, analyses, 1)
    assert nested[1]["total_datasets"] == sections["stats"].first()["total_datasets"] == 3
    assert [d["id"] for d in nested[1]["recent_datasets"]] == ids(sections["recent_datasets"]) == [3, 2, 1]
    assert [(m["month"], m["uploads"]) for m in nested[1]["uploads_per_month"]] == [("Jan", 2), ("Mar", 1)]
    nothing = dashboard(datasets, analyses, 99)["stats"].first()
    assert (nothing["owner_id"], nothing["total_datasets"], nothing["average_quality_score"], nothing["total_rows"]) == (99, 0, 0, 0)
    assert nested[3]["recent_analyses"] is None and nested[3]["average_quality_score"] == 0
