from datetime import datetime, timedelta

import pytest

from framegauge.functions.json_safe import json_rows
from framegauge.operators import column_profile as cp
from framegauge.sources import csv_files, dataset_store
from framegauge.streaming import ingest

MESSY = '''i,im,f,b,bm,d,s,e,a,a
1,1,1.5,True,True,2024-01-01,NA,,None,x
2,,nan,False,,2024-01-02,"two
lines",,n/a,y
3,3,2e3,TRUE,False,2024-01-03,"say ""hi"", ok",,z,z
'''


def test_messy_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MESSY)
    df = csv_files.csv_scan(spark, str(tmp_path))
    assert df.columns == ["i", "im", "f", "b", "bm", "d", "s", "e", "a", "a.1"]
    kinds = [t for _, t in df.dtypes]
    assert kinds == ["bigint", "double", "double", "boolean", "string", "string", "string", "double", "string", "string"]
    missing = {r["column"]: r["missing"] for r in cp.column_missing(df).collect()}
    assert [missing[c] for c in df.columns] == [0, 1, 1, 0, 1, 0, 1, 3, 2, 0]
    assert {r["s"] for r in df.collect()} == {None, "two\nlines", 'say "hi", ok'}


@pytest.mark.parametrize("values, kind", [
    (["1", " 2"], "integer"), (["1", None], "float"), (["1.0", "2"], "float"), (["1d"], "string"), (["1e5", "inf"], "float"),
    (["9223372036854775808"], "float"), (["True", "false"], "boolean"), (["yes"], "string"), ([None], "float")])
def test_infer_types(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert csv_files.infer_types(df)["c"] == kind
    csv_files.with_types(df, {"c": kind}).collect()


def test_ragged_files(spark, tmp_path):
    (tmp_path / "long.csv").write_text('a,b\n1,2\n1,2,3\n')
    (tmp_path / "short.csv").write_text('a,b\n7\n8,"x,y"\n')
    (tmp_path / "header.csv").write_text('a,b\n')
    (tmp_path / "empty.csv").write_text('')
    text = csv_files.csv_text(spark, str(tmp_path), ["a", "b"])
    good, bad = csv_files.reject_unreadable(text)
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [("7", None), ("8", "x,y")]
    assert [r[0].rsplit("/", 1)[1] for r in bad.select("_file_path").collect()] == ["long.csv"]
    admitted = {r["file_name"]: r["reason"] for r in dataset_store.file_admission(dataset_store.file_listing(spark, str(tmp_path))).collect()}
    # Spark does not list files of zero bytes, so an empty file is never admitted.
    assert admitted == {"long.csv": None, "short.csv": None, "header.csv": None}


def test_admission(spark):
    files = spark.createDataFrame([("a.CSV", 5), ("b.exe", 5), ("noext", 5), ("c.parquet", 100), (".csv", 5), ("e.csv", 0)], "file_name string, file_size bigint")
    found = {r["file_name"]: (r["admitted"], r["reason"]) for r in dataset_store.file_admission(files, max_bytes=50).collect()}
    assert found == {"a.CSV": (True, None), "b.exe": (False, "extension not supported"), "noext": (False, "extension not supported"),
                     "c.parquet": (False, "file too large"), ".csv": (False, "extension not supported"), "e.csv": (False, "empty file")}


def test_register_counts_header_only_file(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "h.CSV").write_text("x,y\n")
    files = dataset_store.file_admission(dataset_store.file_listing(spark, str(tmp_path))).where("admitted")
    rows = dataset_store.rows_per_file(csv_files.csv_text(spark, str(tmp_path), ["x", "y"]))
    found = {r["original_filename"]: r for r in dataset_store.register_datasets(files, rows, 2, 7).collect()}
    assert {n: r["rows"] for n, r in found.items()} == {"a b.csv": 2, "h.CSV": 0}
    assert {r["file_type"] for r in found.values()} == {"csv"} and len({r["id"] for r in found.values()}) == 2


def test_latest_analysis_wins(spark):
    rows = [(1, 10, datetime(2024, 1, 1)), (2, 10, datetime(2024, 1, 2)), (3, 10, datetime(2024, 1, 2)), (4, 11, datetime(2024, 1, 1))]
    kept = dataset_store.keep_latest(spark.createDataFrame(rows, "id bigint, dataset_id bigint, created_at timestamp_ntz"))
    assert {r["id"] for r in kept.collect()} == {3, 4}


def test_export(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "stored"))
    registry = spark.createDataFrame([(1, 7, str(tmp_path / "stored"), "parquet", "numbers.csv"), (2, 7, str(tmp_path / "gone"), "parquet", "g.csv")],
                                     "id bigint, owner_id bigint, file_path string, file_type string, original_filename string")
    target = dataset_store.export_dataset(spark, registry, 1, 7, str(tmp_path / "out"))
    assert target.endswith("numbers.csv") and csv_files.csv_scan(spark, target).count() == 5
    assert dataset_store.export_dataset(spark, registry, 1, 8, str(tmp_path / "out")) is None
    assert dataset_store.export_dataset(spark, registry, 2, 7, str(tmp_path / "out")) is None


def test_headers_in_any_order_and_extra_fields(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "2.csv").write_text("b,a\ny,2\n")
    assert sorted(map(tuple, csv_files.csv_scan(spark, str(tmp_path)).collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "3.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(ValueError, match="3.csv"):
        csv_files.csv_scan(spark, str(tmp_path))


def test_names_that_differ_in_case(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,ID,id\n1,2,3\n")
    assert csv_files.csv_scan(spark, str(tmp_path)).columns == ["id", "ID.1", "id.2"]


def test_fields_of_a_very_long_record(spark):
    record = '1,"' + 'a,""b' * 200_000 + '",2'
    df = spark.createDataFrame([(record,)], "r string")
    assert df.select(csv_files.field_count(df.r)).first()[0] == 3


def test_stored_csv_is_exported_whole(spark, tmp_path):
    cells = [('say "hi", ok', "two\nlines"), ("back\\slash", " spaced "), ("plain", 'q"')]
    spark.createDataFrame(cells, "a string, b string").coalesce(1).write.options(**csv_files.writer_options()).csv(str(tmp_path / "s"))
    registry = spark.createDataFrame([(1, 7, str(tmp_path / "s"), "csv", "t.csv")],
                                     "id bigint, owner_id bigint, file_path string, file_type string, original_filename string")
    target = dataset_store.export_dataset(spark, registry, 1, 7, str(tmp_path / "out"))
    found = csv_files.csv_text(spark, target).select("a", "b")
    assert sorted(map(tuple, found.collect())) == sorted(cells)


def test_json_safe(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), datetime(2024, 1, 2, 3, 4, 5, 600), [datetime(2024, 1, 1)], {"k": float("nan")}, timedelta(days=1))],
        "i int, f double, t timestamp_ntz, a array<timestamp_ntz>, m map<string,double>, d interval day to second")
    assert json_rows(df).first()[0] == (
        '{"i":1,"f":null,"t":"2024-01-02T03:04:05.000600","a":["2024-01-01T00:00:00"],"m":{"k":null},'
        '"d":"INTERVAL \'1 00:00:00\' DAY TO SECOND"}')


def run(spark, landing, store):
    query = ingest.ingest_stream(spark, str(landing), str(store), owner=3, max_files=4)
    query.awaitTermination()
    assert query.exception() is None
    return [f.collect() for f in ingest.ingested(spark, str(store))]


def test_stream_profiles_each_file_once(spark, tmp_path):
    landing, store = tmp_path / "landing", tmp_path / "store"
    landing.mkdir()
    (landing / "one.csv").write_text("a,b\n1,2.5\n2,NA\n2,NA\n")
    (landing / "TWO.CSV").write_text("a,b\n5,1\n")
    (landing / "bad.csv").write_text("a,b\n5,1,9\n")
    (landing / "skip.txt").write_text("a,b\n5,1\n")
    (landing / "turned.csv").write_text("b,a\n0.5,1\n")
    (landing / "word.csv").write_text("a,b\nxx,1\n7,2\n")
    (landing / "other.csv").write_text('k,"say ""hi"", ok"\n1,"x,y"\n')
    (landing / "header.csv").write_text("a,b\n")
    datasets, analyses = run(spark, landing, store)
    assert {r["original_filename"]: r["rows"] for r in datasets} == {
        "one.csv": 3, "TWO.CSV": 1, "turned.csv": 1, "word.csv": 2, "other.csv": 1, "header.csv": 0}
    kinds = {r["dataset_id"]: {c["name"]: c["dtype"] for c in r["column_info"]} for r in analyses}
    by_name = {r["original_filename"]: kinds.get(r["id"]) for r in datasets}
    assert by_name["turned.csv"] == {"b": "float", "a": "integer"} and by_name["header.csv"] is None
    assert by_name["word.csv"] == {"a": "string", "b": "integer"}
    assert by_name["other.csv"] == {"k": "integer", 'say "hi", ok': "string"}
    by_id = {r["dataset_id"]: r for r in analyses}
    one = by_id[next(r["id"] for r in datasets if r["original_filename"] == "one.csv")]
    assert (one["summary"]["missing_cells"], one["summary"]["duplicate_rows"]) == (2, 1)
    assert one["quality_score"] == 100 - int(2 / 3 * 40) - int(1 / 3 * 30)
    rejected = spark.read.parquet(str(store / "rejected")).collect()
    assert [(r["file_path"].rsplit("/", 1)[1], r["reason"]) for r in rejected] == [("bad.csv", "unreadable")]
    (landing / "three.csv").write_text("a,b\n8,8\n")
    again, more = run(spark, landing, store)
    assert len(again) == 7 and len(more) == 6
    assert {r["created_at"] for r in more} > {r["created_at"] for r in analyses}
