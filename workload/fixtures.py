"""Inputs of the registered queries: the given tables and frames derived from them.

Each frame has its SQL twin, a common table expression over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegauge.plans.table_profile import group_scores
from framegauge.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where there are any: two columns with gaps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCS_LABELED = """docs_labeled AS (
  SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"""
DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
DOCS_NUMBERS = ["doc_id", "n_chars", "quality", "toxic"]
DOCS_TEXTS = ["text", "lang", "source"]


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items without a discount or tax have none, rather than 0."""
    return (table(spark, sf_dir, "lineitem")
            .withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
            .withColumn("l_tax", F.nullif("l_tax", F.lit(0.0))))


LINEITEM_GAPS = """lineitem_gaps AS (
  SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax) FROM lineitem)"""
LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]
LINEITEM_COLUMNS = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


def events_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id")


def events_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh event is there twice, in all its columns."""
    events = table(spark, sf_dir, "events")
    return events.unionByName(events.where(F.col("event_id") % 7 == 0))


def const_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "value", F.lit(1.0).alias("constant"))


def nan_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents have NaN for a length."""
    length = F.when(F.col("n_chars") < 300, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", length.alias("length"))


NAN_COL = """nan_col AS (
  SELECT doc_id, lang, CASE WHEN n_chars < 300 THEN NULL ELSE n_chars::DOUBLE END AS length FROM documents)"""


def reg_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a dataset registry: the customer owns it, its line items are the rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"))
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".dat")).alias("filename"),
        F.concat_ws("_", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("original_filename"),
        F.when(status == "O", "csv").when(status == "F", "xlsx").otherwise("xls").alias("file_type"),
        F.concat(F.lit("/data/"), F.col("o_orderkey").cast("string")).alias("file_path"),
        F.floor("o_totalprice").cast("bigint").alias("file_size"),
        F.coalesce("n", F.lit(0)).alias("rows"), F.lit(11).cast("bigint").alias("columns"),
        F.col("o_orderdate").alias("uploaded_at"))


REG_DATASETS = """reg_datasets AS (
  SELECT o_orderkey AS id, o_custkey AS owner_id, o_orderkey::VARCHAR || '.dat' AS filename,
    o_orderpriority || '_' || o_orderkey::VARCHAR AS original_filename,
    CASE o_orderstatus WHEN 'O' THEN 'csv' WHEN 'F' THEN 'xlsx' ELSE 'xls' END AS file_type,
    '/data/' || o_orderkey::VARCHAR AS file_path,
    floor(o_totalprice)::BIGINT AS file_size, coalesce(n, 0)::BIGINT AS rows, 11::BIGINT AS columns,
    o_orderdate AS uploaded_at
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    ON o_orderkey = l_orderkey)"""


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each order's line items, and the last day one was shipped."""
    return group_scores(lineitem_gaps(spark, sf_dir), "l_orderkey", latest="l_shipdate")


# Analyses already stored for a session and input folder.
_stored: dict[tuple[str, str], str] = {}


def reg_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyses table: profiled once per session, then read as stored."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = scratch_path(spark, "analyses")
        scored_orders(spark, sf_dir).where("l_orderkey IS NOT NULL").select(
            F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("dataset_id"), "quality_score",
            F.col("l_shipdate").alias("created_at"),
        ).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


_SCORED = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def quartile_sql(values: str, prob: float) -> str:
    """Linear interpolation in an ordered list, from the nearer end.

    quantile_cont always starts at the lower end; the last bit can differ, which
    matters where a value lies exactly on a fence.
    """
    pos = f"((len({values}) - 1) * {prob}::DOUBLE)"
    lo, hi = f"{values}[floor({pos})::BIGINT + 1]", f"{values}[ceil({pos})::BIGINT + 1]"
    t = f"({pos} - floor({pos}))"
    return (f"CASE WHEN {lo} = {hi} THEN {lo} WHEN {t} < 0.5 THEN {lo} + ({hi} - {lo}) * {t} "
            f"ELSE {hi} - ({hi} - {lo}) * (1 - {t}) END")


SCORED_ORDERS = f"""{LINEITEM_GAPS}, order_lists AS (
  SELECT l_orderkey AS k, {", ".join(f"list({c}::DOUBLE ORDER BY {c}) FILTER (WHERE {c} IS NOT NULL) AS {c}_l" for c in _SCORED)}
  FROM lineitem_gaps GROUP BY l_orderkey), order_fences AS (
  SELECT k, {", ".join(f"{quartile_sql(c + '_l', 0.25)} AS {c}_q1, {quartile_sql(c + '_l', 0.75)} AS {c}_q3" for c in _SCORED)}
  FROM order_lists), order_copies AS (
  SELECT l_orderkey AS k, sum(n - 1) AS d FROM (
    SELECT {", ".join(LINEITEM_COLUMNS)}, count(*) AS n FROM lineitem_gaps GROUP BY ALL) GROUP BY l_orderkey),
order_counts AS (
  SELECT l_orderkey AS k, count(*) AS n, {" + ".join(f"count(*) - count({c})" for c in LINEITEM_COLUMNS)} AS m,
    {" + ".join(f"count(*) FILTER (WHERE {c} < {c}_q1 - ({c}_q3 - {c}_q1) * 1.5 OR {c} > {c}_q3 + ({c}_q3 - {c}_q1) * 1.5)" for c in _SCORED)} AS o
  FROM lineitem_gaps JOIN order_fences ON l_orderkey = k GROUP BY l_orderkey),
scored_orders AS (
  SELECT c.k AS l_orderkey, n::BIGINT AS rows, m::BIGINT AS missing_cells, d::BIGINT AS duplicate_rows, o::BIGINT AS outlier_cells,
    greatest(0, 100 - trunc(m / n * 40)::INT - trunc(d / n * 30)::INT - trunc(o / n * 30)::INT)::INT AS quality_score
  FROM order_counts c JOIN order_copies USING (k))"""
REG_ANALYSES = f"""{SCORED_ORDERS}, reg_analyses AS (
  SELECT l_orderkey AS id, l_orderkey AS dataset_id, quality_score, created_at FROM scored_orders
  JOIN (SELECT l_orderkey, max(l_shipdate) AS created_at FROM lineitem GROUP BY l_orderkey) USING (l_orderkey))"""
REGISTRY = f"{REG_DATASETS}, {REG_ANALYSES}"


def reg_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"),
        F.concat(F.lower("c_name"), F.lit("@x")).alias("email"))


REG_USERS = """reg_users AS (
  SELECT c_custkey AS id, c_name AS full_name, lower(c_name) || '@x' AS email FROM customer)"""
