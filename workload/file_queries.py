"""Files in and out.  Inputs are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framegauge.functions.json_safe import json_rows
from framegauge.plans.table_profile import profile_by_group
from framegauge.session import scratch_path
from framegauge.sources import csv_files, dataset_store
from framegauge.streaming import ingest
from workload import fixtures as fx

ORDER_TEXT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _orders_text(spark, sf):
    """Orders as a CSV file would hold them: all text."""
    return fx.table(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in ORDER_TEXT])


def csv_scan(spark, sf):
    """Documents with quotes, commas and line breaks in their texts."""
    path = scratch_path(spark, "documents-csv")
    fx.table(spark, sf, "documents").write.options(**csv_files.writer_options()).csv(path)
    return csv_files.csv_scan(spark, path)


def csv_scan_orders(spark, sf):
    path = scratch_path(spark, "orders-csv")
    _orders_text(spark, sf).write.option("header", "true").csv(path)
    return csv_files.csv_scan(spark, path)


TOKENS = ("NA", "n/a", "<NA>", "None", "nan")


def _tokens(spark, sf):
    """Every fifth length of a document is written as a missing-value token."""
    token = F.element_at(F.array(*[F.lit(t) for t in TOKENS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") % 5 == 0, token).otherwise(F.col("n_chars").cast("string")).alias("n_chars"))


def na_token_normalize(spark, sf):
    return csv_files.na_token_normalize(_tokens(spark, sf)).select("doc_id", F.coalesce("n_chars", F.lit("-")).alias("n_chars"))


def infer_types(spark, sf):
    orders = fx.table(spark, sf, "orders")
    even = F.col("o_orderkey") % 2 == 0
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("whole"),
        F.when(even, F.col("o_custkey").cast("string")).otherwise("NA").alias("whole_gaps"),
        F.col("o_totalprice").cast("string").alias("real"),
        F.when(even, "True").otherwise("FALSE").alias("flag"),
        F.when(even, "True").otherwise("null").alias("flag_gaps"),
        F.col("o_orderdate").cast("string").alias("date"),
        F.col("o_orderpriority").alias("word"), F.lit("").alias("nothing"))
    kinds = csv_files.infer_types(csv_files.na_token_normalize(text))
    return spark.createDataFrame(list(kinds.items()), "column string, kind string")


FORMATS = {"click": "csv", "view": "parquet", "signup": "orc", "error": "json"}


def file_admission(spark, sf):
    """Events as files of one format per type; those that are left are plain text."""
    path = scratch_path(spark, "formats")
    events = fx.table(spark, sf, "events")
    for kind, fmt in FORMATS.items():
        events.where(F.col("event_type") == kind).write.format(fmt).save(f"{path}/event_type={kind}")
    events.where(~F.col("event_type").isin(*FORMATS)).select("event_type", "props").write.mode("append").partitionBy("event_type").text(path)
    found = dataset_store.file_admission(dataset_store.file_listing(spark, path)).where("file_name NOT LIKE '\\_%'")
    return found.select(_type_of("file_path"), "file_type", "admitted", F.coalesce("reason", F.lit("-")).alias("reason")).distinct()


EVENT_COLUMNS = ["event_id", "ts", "user_id", "value", "props"]


def _events_csv(spark, sf, broken: str | None):
    """Events by type as CSV files; files of the ``broken`` type have a field too many."""
    path = scratch_path(spark, "events-csv")
    events = fx.table(spark, sf, "events").select("event_type", *EVENT_COLUMNS)
    is_broken = F.col("event_type") == F.lit(broken or "")
    events.where(~is_broken).write.partitionBy("event_type").options(**csv_files.writer_options()).csv(path)
    if broken:
        props = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('",x')).alias("props")
        events.where(is_broken).select("event_type", *EVENT_COLUMNS[:-1], props).write.mode("append").partitionBy(
            "event_type").option("header", "true").option("quote", "").csv(path)
    return path


def _type_of(path):
    return F.regexp_extract(path, "event_type=([^/]+)", 1).alias("event_type")


def reject_unreadable(spark, sf):
    path = _events_csv(spark, sf, "purchase")
    good, bad = csv_files.reject_unreadable(csv_files.csv_text(spark, path, EVENT_COLUMNS))
    rows = good.groupBy(_type_of(csv_files.FILE_PATH)).agg(F.count(F.lit(1)).alias("rows")).withColumn("state", F.lit("kept"))
    return rows.unionByName(bad.groupBy(_type_of(csv_files.FILE_PATH)).agg(F.sum("bad_records").alias("rows"))
                            .withColumn("state", F.lit("rejected")))


def register_dataset(spark, sf):
    """Rows registered per type of event, over all of its files."""
    path = _events_csv(spark, sf, None)
    files = dataset_store.file_admission(dataset_store.file_listing(spark, path, "*.csv")).where("admitted")
    rows = dataset_store.rows_per_file(csv_files.csv_text(spark, path, EVENT_COLUMNS))
    found = dataset_store.register_datasets(files, rows, len(EVENT_COLUMNS), owner=7)
    return found.groupBy(_type_of("file_path"), "owner_id", "file_type").agg(
        F.sum("rows").alias("rows"), F.max("columns").alias("columns"))


def persist_analysis(spark, sf):
    """Two generations of analyses are stored; the later one is read back."""
    path = scratch_path(spark, "analyses")
    events = fx.table(spark, sf, "events")
    for year, frame in ((2024, events.where(F.col("value") > 1)), (2025, events)):
        nested = profile_by_group(frame, "event_type").analyses()
        stamp = F.lit(f"{year}-01-01").cast("timestamp_ntz")
        dataset_store.persist_analyses(dataset_store.as_analyses(nested, "event_type", stamp), path)
    stored = dataset_store.load_analyses(spark, path)
    info = F.explode("column_info").alias("info")
    return stored.select(F.col("dataset_id").alias("event_type"), "summary", "duplicates", "outliers", "created_at", info).select(
        "event_type", F.year("created_at").alias("year"), F.col("summary.rows").alias("rows"),
        F.col("duplicates.count").alias("duplicate_rows"), F.col("info.name").alias("column"),
        F.col("info.unique").alias("unique"), F.coalesce(F.element_at("outliers", F.col("info.name")), F.lit(-1)).alias("outliers"))


def json_safe(spark, sf):
    events = fx.table(spark, sf, "events").select(
        "event_id", "ts", F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.lit(1.5)).alias("value"),
        F.array("ts").alias("times"), "props")
    return json_rows(events)


def export_dataset(spark, sf):
    """Documents stored as CSV, exported under their name and read back."""
    stored, folder = scratch_path(spark, "stored"), scratch_path(spark, "exported")
    fx.table(spark, sf, "documents").write.options(**csv_files.writer_options()).csv(stored)
    registry = spark.createDataFrame(
        [(1, 7, stored, "csv", "documents.csv")],
        "id bigint, owner_id bigint, file_path string, file_type string, original_filename string")
    if dataset_store.export_dataset(spark, registry, 1, 8, folder) is not None:
        raise ValueError("exported for an owner that has no such dataset")
    return csv_files.csv_scan(spark, dataset_store.export_dataset(spark, registry, 1, 7, folder))


def ingest_stream(spark, sf):
    """Events and customers land as files of different headers, are profiled and
    registered; totals by type of event."""
    path, store = _events_csv(spark, sf, "purchase"), scratch_path(spark, "store")
    fx.table(spark, sf, "customer").write.options(**csv_files.writer_options()).csv(f"{path}/event_type=customer")
    query = ingest.ingest_stream(spark, path, store, owner=7)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    datasets, analyses = ingest.ingested(spark, store)
    return (analyses.join(datasets.select(F.col("id").alias("dataset_id"), "file_path", "rows"), "dataset_id")
            .groupBy(_type_of("file_path"))
            .agg(F.sum("rows").alias("rows"), F.sum("summary.rows").alias("profiled_rows"),
                 F.sum("summary.missing_cells").alias("missing_cells"), F.max("summary.columns").alias("columns")))


_NO_TOKEN = "('NA', 'n/a', '<NA>', 'None', 'nan', '', 'null')"
_INFER = {
    "whole": "o_orderkey::VARCHAR", "whole_gaps": "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR END",
    "real": "o_totalprice::VARCHAR", "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'FALSE' END",
    "flag_gaps": "CASE WHEN o_orderkey % 2 = 0 THEN 'True' END", "date": "o_orderdate::VARCHAR",
    "word": "o_orderpriority", "nothing": "NULL::VARCHAR",
}
_FENCED = "count(*) FILTER (WHERE {c} < q1 - (q3 - q1) * 1.5 OR {c} > q3 + (q3 - q1) * 1.5)"

ENTRIES = {
    "csv_scan": (csv_scan, "SELECT * FROM documents"),
    "csv_scan_orders": (csv_scan_orders, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::VARCHAR AS o_orderdate, "
                 "o_orderpriority FROM orders"),
    "na_token_normalize": (na_token_normalize, "SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN '-' ELSE n_chars::VARCHAR END AS n_chars "
                           "FROM documents"),
    "infer_types": (infer_types, "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN count(v) = 0 THEN 'float' WHEN count(try_cast(v AS BIGINT)) = count(v) "
        "AND NOT bool_or(contains(v, '.')) THEN CASE WHEN count(v) = count(*) THEN 'integer' ELSE 'float' END "
        "WHEN count(try_cast(v AS DOUBLE)) = count(v) THEN 'float' "
        "WHEN count(*) = count(*) FILTER (WHERE lower(v) IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS kind "
        f"FROM (SELECT {e} AS v FROM orders)" for c, e in _INFER.items())),
    "file_admission": (file_admission, "SELECT DISTINCT event_type, coalesce(" + "CASE event_type " + " ".join(
        f"WHEN '{k}' THEN '{f}'" for k, f in FORMATS.items()) + " END, 'txt') AS file_type, event_type <> 'purchase' AS admitted, "
        "CASE event_type WHEN 'purchase' THEN 'extension not supported' ELSE '-' END AS reason FROM events"),
    "reject_unreadable": (reject_unreadable, "SELECT event_type, count(*) AS rows, CASE event_type WHEN 'purchase' THEN 'rejected' "
                          "ELSE 'kept' END AS state FROM events GROUP BY event_type"),
    "register_dataset": (register_dataset, "SELECT event_type, 7::BIGINT AS owner_id, 'csv' AS file_type, count(*) AS rows, "
                         "5 AS columns FROM events GROUP BY event_type"),
    "persist_analysis": (persist_analysis, """WITH dups AS (SELECT event_type, sum(n - 1)::BIGINT AS duplicate_rows FROM (
  SELECT *, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type)
SELECT event_type, 2025 AS year, count(*) AS rows, any_value(duplicate_rows) AS duplicate_rows, 'ts' AS "column",
  count(DISTINCT ts) AS "unique", (-1)::BIGINT AS outliers FROM events JOIN dups USING (event_type) GROUP BY event_type
UNION ALL
SELECT event_type, 2025 AS year, count(*) AS rows, any_value(duplicate_rows) AS duplicate_rows, 'props' AS "column",
  count(DISTINCT props) AS "unique", (-1)::BIGINT AS outliers FROM events JOIN dups USING (event_type) GROUP BY event_type
UNION ALL
""" + "\nUNION ALL\n".join(
        f"SELECT event_type, 2025 AS year, count(*) AS rows, any_value(duplicate_rows) AS duplicate_rows, '{c}' AS \"column\", "
        f"count(DISTINCT {c}) AS \"unique\", {_FENCED.replace('{c}', c)} AS outliers FROM events JOIN dups USING (event_type) JOIN "
        f"(SELECT event_type, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events GROUP BY event_type) "
        "USING (event_type) GROUP BY event_type" for c in ("event_id", "user_id", "value"))),
    "json_safe": (json_safe, """WITH e AS (SELECT *, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events)
SELECT '{"event_id":' || event_id || ',"ts":"' || iso || '","value":' || CASE WHEN value < 1 THEN 'null' ELSE '1.5' END
  || ',"times":["' || iso || '"],"props":' || coalesce(to_json(props)::VARCHAR, 'null') || '}' AS json FROM e"""),
    "export_dataset": (export_dataset, "SELECT * FROM documents"),
    "ingest_stream": (ingest_stream, "SELECT event_type, count(*) AS rows, count(*) AS profiled_rows, "
                      "(5 * count(*) - count(event_id) - count(ts) - count(user_id) - count(value) - count(props))::BIGINT AS missing_cells, "
                      "5::BIGINT AS columns FROM events WHERE event_type <> 'purchase' GROUP BY event_type UNION ALL "
                      "SELECT 'customer', count(*), count(*), (5 * count(*) - count(c_custkey) - count(c_name) - count(c_nationkey) "
                      "- count(c_acctbal) - count(c_mktsegment))::BIGINT, (SELECT count(*) FROM (DESCRIBE customer)) FROM customer"),
}
