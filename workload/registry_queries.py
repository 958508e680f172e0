"""Registry queries, answered for all owners at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from framegauge.operators import registry as rg
from framegauge.operators.name_index import build_name_index
from framegauge.operators.rank_directory import build_rank_directory
from framegauge.plans.dashboard import dashboards
from framegauge.session import scratch_path
from workload import fixtures as fx

SEARCH = "urgent_1"
MONTH_SQL = "strftime(uploaded_at, '%b')"


def _datasets(query):
    return lambda spark, sf: query(fx.reg_datasets(spark, sf))


def _both(query):
    return lambda spark, sf: query(fx.reg_datasets(spark, sf), fx.reg_analyses(spark, sf))


def owner_scope(spark, sf):
    """Datasets of the owners in one market segment."""
    owners = fx.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("owner_id"))
    return rg.owner_scope(fx.reg_datasets(spark, sf), owners).select("id", "owner_id", "rows")


def _asked(spark, sf):
    """Right and wrong owners: urgent orders are asked for by the next customer."""
    shift = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") + shift).alias("owner_id"))


ASKED = """asked AS (
  SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS owner_id FROM orders)"""


def dataset_lookup(spark, sf):
    return rg.dataset_lookup(fx.reg_datasets(spark, sf), _asked(spark, sf)).select("id", "owner_id", "original_filename")


def analysis_lookup(spark, sf):
    return rg.analysis_lookup(fx.reg_analyses(spark, sf), fx.reg_datasets(spark, sf), _asked(spark, sf)).select(
        "dataset_id", "quality_score")


def uploads_per_month(spark, sf):
    return rg.uploads_per_month(fx.reg_datasets(spark, sf))


# Rows of a part of a listing.
LISTING_PART_ROWS = 50_000
LISTED = 100


def page_listing(spark, sf):
    """The page in the middle of the listing of all datasets by size, from the parts that hold it."""
    datasets = fx.reg_datasets(spark, sf)
    listing = build_rank_directory(datasets, scratch_path(spark, "listing"), "file_size", per_owner=False, part_rows=LISTING_PART_ROWS)
    return listing.page(datasets.count() // 2 // LISTED + 1, LISTED).select("place", "id", "file_size")


def page_listing_owners(spark, sf):
    """The third page of every owner, from a listing laid out by owner."""
    listing = build_rank_directory(fx.reg_datasets(spark, sf), scratch_path(spark, "listing"), "rows", "asc", part_rows=LISTING_PART_ROWS)
    return listing.page_per_owner(3, 4).select("owner_id", "place", "id", "rows")


# Searches by letters, by a wildcard between letters, and by too few letters.
SEARCHES = ("urgent_1", "5-low%99", "not specified_77", "9")


def search_index(spark, sf):
    index = build_name_index(fx.reg_datasets(spark, sf), scratch_path(spark, "names"))
    found = [index.search(s).select(F.lit(s).alias("search"), "id", "original_filename") for s in SEARCHES]
    return reduce(lambda a, b: a.unionByName(b), found)


def _new_names(spark, sf):
    """Every other request comes from somebody who is not the owner."""
    return fx.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("owner_id"),
        F.concat(F.lit("renamed_"), F.col("o_orderkey").cast("string")).alias("new_name"))


def rename_dataset(spark, sf):
    return rg.rename_dataset(fx.reg_datasets(spark, sf), _new_names(spark, sf)).select("id", "original_filename", "rows")


def delete_dataset(spark, sf):
    """Rows left per table after deleting the datasets of one status."""
    gone = fx.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("owner_id"))
    datasets, analyses = rg.delete_dataset(fx.reg_datasets(spark, sf), fx.reg_analyses(spark, sf), gone)
    return datasets.select(F.lit("datasets").alias("kept"), "id").unionByName(
        analyses.select(F.lit("analyses").alias("kept"), F.col("dataset_id").alias("id")))


def user_lookup(spark, sf):
    """Datasets with their owner, and customers found again by email."""
    users = fx.reg_users(spark, sf)
    owned = rg.user_lookup(fx.reg_datasets(spark, sf).select("id", "owner_id"), users, by="id", frame_key="owner_id")
    return owned.select("id", "owner_id", "full_name", "email")


def new_user_check(spark, sf):
    """Suppliers sign up under one of 40 names each; some are customers already."""
    candidates = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.when(F.col("s_acctbal") > 5000, "supplier#").otherwise("customer#"),
                 F.lpad((F.col("s_suppkey") % 40).cast("string"), 9, "0"), F.lit("@x")).alias("email"))
    return rg.new_user_check(candidates, fx.reg_users(spark, sf))


def dashboard(spark, sf):
    """Nested dashboards, lists shown as text."""
    nested = dashboards(fx.reg_datasets(spark, sf), fx.reg_analyses(spark, sf))

    def shown(column, *fields):
        return F.array_join(F.transform(column, lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields])), ",").alias(column)

    return nested.select(
        "owner_id", "total_datasets", "total_analyses", "average_quality_score", "total_rows",
        shown("uploads_per_month", "month", "uploads"), shown("file_types", "file_type", "count"),
        shown("quality_distribution", "range", "count"), shown("recent_datasets", "id"),
        shown("recent_analyses", "dataset_id"))


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


JOINED = "reg_datasets d LEFT JOIN reg_analyses a ON a.dataset_id = d.id"
RANGES = (("90-100", "quality_score >= 90"), ("80-89", "quality_score >= 80 AND quality_score < 90"),
          ("70-79", "quality_score >= 70 AND quality_score < 80"), ("60-69", "quality_score >= 60 AND quality_score < 70"),
          ("<60", "quality_score < 60"))
_RECENT_D = "row_number() OVER (PARTITION BY owner_id ORDER BY uploaded_at DESC, d.id DESC)"
_RECENT_A = "row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, a.id DESC)"
_MONTH_COUNTS = ", ".join(f"count(*) FILTER (WHERE month(uploaded_at) = {i}) AS m{i}" for i in range(1, 13))

ENTRIES = {
    "owner_scope": (owner_scope, _with(fx.REG_DATASETS, "SELECT id, owner_id, rows FROM reg_datasets WHERE owner_id IN "
                                       "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")),
    "dataset_lookup": (dataset_lookup, _with(f"{fx.REG_DATASETS}, {ASKED}",
        "SELECT id, owner_id, original_filename FROM reg_datasets WHERE (id, owner_id) IN (SELECT (id, owner_id) FROM asked)")),
    "analysis_lookup": (analysis_lookup, _with(f"{fx.REGISTRY}, {ASKED}",
        "SELECT dataset_id, quality_score FROM reg_analyses a JOIN reg_datasets d ON a.dataset_id = d.id "
        "WHERE (d.id, d.owner_id) IN (SELECT (id, owner_id) FROM asked)")),
    "total_datasets": (_datasets(rg.total_datasets), _with(fx.REG_DATASETS,
        "SELECT owner_id, count(id) AS total_datasets FROM reg_datasets GROUP BY owner_id")),
    "total_rows": (_datasets(rg.total_rows), _with(fx.REG_DATASETS,
        "SELECT owner_id, sum(rows)::BIGINT AS total_rows FROM reg_datasets GROUP BY owner_id")),
    "total_analyses": (_both(rg.total_analyses), _with(fx.REGISTRY,
        f"SELECT owner_id, count(a.id) AS total_analyses FROM {JOINED} GROUP BY owner_id")),
    "average_quality": (_both(rg.average_quality), _with(fx.REGISTRY,
        f"SELECT owner_id, round(coalesce(avg(quality_score), 0), 2) AS average_quality_score FROM {JOINED} GROUP BY owner_id")),
    "recent_datasets": (lambda spark, sf: rg.recent_datasets(fx.reg_datasets(spark, sf), fx.reg_analyses(spark, sf))
        .withColumn("quality_score", F.coalesce("quality_score", F.lit(-1))), _with(fx.REGISTRY,
        f"""SELECT owner_id, recent, id, filename, original_filename, rows, columns, uploaded_at, quality_score FROM (
  SELECT d.*, coalesce(quality_score, -1) AS quality_score, {_RECENT_D}::INT AS recent FROM {JOINED}) WHERE recent <= 5""")),
    "recent_analyses": (_both(rg.recent_analyses), _with(fx.REGISTRY,
        f"""SELECT * FROM (SELECT owner_id, {_RECENT_A}::INT AS recent, a.id AS analysis_id, dataset_id,
  original_filename AS dataset_name, quality_score, created_at
  FROM reg_datasets d JOIN reg_analyses a ON a.dataset_id = d.id) WHERE recent <= 5""")),
    "uploads_per_month": (uploads_per_month, _with(fx.REG_DATASETS,
        f"SELECT owner_id, month(uploaded_at)::INT AS month_number, {MONTH_SQL} AS month, count(id) AS uploads "
        "FROM reg_datasets GROUP BY ALL")),
    "file_type_distribution": (_datasets(rg.file_type_distribution), _with(fx.REG_DATASETS,
        "SELECT owner_id, upper(file_type) AS file_type, count(id) AS count FROM reg_datasets GROUP BY owner_id, reg_datasets.file_type")),
    "quality_distribution": (_both(rg.quality_distribution), _with(fx.REGISTRY, "\nUNION ALL\n".join(
        f"SELECT owner_id, {i} AS position, '{name}' AS range, count(*) FILTER (WHERE {test}) AS count "
        f"FROM {JOINED} GROUP BY owner_id" for i, (name, test) in enumerate(RANGES)))),
    "search_datasets": (lambda spark, sf: rg.search_datasets(fx.reg_datasets(spark, sf), SEARCH).select("id", "original_filename"),
        _with(fx.REG_DATASETS, f"SELECT id, original_filename FROM reg_datasets WHERE original_filename ILIKE '%{SEARCH}%'")),
    "sort_datasets": (lambda spark, sf: rg.sort_datasets(fx.reg_datasets(spark, sf), "file_size", "ASC").select("id", "file_size"),
        _with(fx.REG_DATASETS, "SELECT id, file_size FROM reg_datasets ORDER BY file_size, id")),
    "page_datasets": (lambda spark, sf: rg.page_per_owner(fx.reg_datasets(spark, sf), 2, 4, "file_size")
        .select("owner_id", "place", "id", "file_size"), _with(fx.REG_DATASETS,
        "SELECT * FROM (SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY file_size DESC, id DESC)::INT AS place, "
        "id, file_size FROM reg_datasets) WHERE place > 4 AND place <= 8")),
    "page_listing": (page_listing, _with(fx.REG_DATASETS,
        f"SELECT place, id, file_size FROM (SELECT row_number() OVER (ORDER BY file_size DESC, id DESC) AS place, count(*) OVER () AS n, "
        f"id, file_size FROM reg_datasets) WHERE (place - 1) // {LISTED} = n // 2 // {LISTED}")),
    "page_listing_owners": (page_listing_owners, _with(fx.REG_DATASETS,
        "SELECT * FROM (SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY rows, id) AS place, "
        "id, rows FROM reg_datasets) WHERE place > 8 AND place <= 12")),
    "search_index": (search_index, _with(fx.REG_DATASETS, "\nUNION ALL\n".join(
        f"SELECT '{s}' AS search, id, original_filename FROM reg_datasets WHERE original_filename ILIKE '%{s}%'" for s in SEARCHES))),
    "page_meta": (lambda spark, sf: rg.page_meta(rg.search_datasets(fx.reg_datasets(spark, sf), "high"), 1, 3, per_owner=True),
        _with(fx.REG_DATASETS, "SELECT owner_id, count(id) AS total, 1 AS page, 3 AS page_size, "
              "greatest(ceil(count(id) / 3.0), 1)::BIGINT AS pages FROM reg_datasets "
              "WHERE original_filename ILIKE '%high%' GROUP BY owner_id")),
    "rename_dataset": (rename_dataset, _with(fx.REG_DATASETS,
        "SELECT id, CASE WHEN file_type = 'xls' AND id % 2 = 0 THEN 'renamed_' || id::VARCHAR ELSE original_filename END AS original_filename, "
        "rows FROM reg_datasets")),
    "delete_dataset": (delete_dataset, _with(fx.REG_DATASETS,
        "SELECT 'datasets' AS kept, id FROM reg_datasets WHERE file_type <> 'xlsx' OR id % 2 = 1 UNION ALL "
        "SELECT 'analyses', id FROM reg_datasets WHERE (file_type <> 'xlsx' OR id % 2 = 1) AND rows > 0")),
    "user_datasets": (lambda spark, sf: rg.user_datasets(fx.reg_datasets(spark, sf)).select("owner_id", "id", "uploaded_at"),
        _with(fx.REG_DATASETS, "SELECT owner_id, id, uploaded_at FROM reg_datasets")),
    "user_lookup": (user_lookup, _with(f"{fx.REG_DATASETS}, {fx.REG_USERS}",
        "SELECT d.id, owner_id, full_name, email FROM reg_datasets d LEFT JOIN reg_users u ON u.id = owner_id")),
    "new_user_check": (new_user_check, _with(f"""{fx.REG_USERS}, candidates AS (
  SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 'supplier#' ELSE 'customer#' END
    || lpad((s_suppkey % 40)::VARCHAR, 9, '0') || '@x' AS email FROM supplier)""",
        "SELECT id, email, email NOT IN (SELECT email FROM reg_users) AND id = min(id) OVER (PARTITION BY email) AS accepted "
        "FROM candidates")),
    "dashboard": (dashboard, _with(fx.REGISTRY, f""", base AS (SELECT d.*, a.id AS analysis_id, quality_score, created_at,
    {_RECENT_D} AS rd FROM {JOINED}), ranked AS (SELECT *, row_number() OVER (
    PARTITION BY owner_id ORDER BY created_at DESC NULLS LAST, analysis_id DESC NULLS LAST) AS ra FROM base),
types AS (SELECT owner_id, string_agg(upper(file_type) || ':' || n, ',' ORDER BY upper(file_type)) AS file_types
  FROM (SELECT owner_id, file_type, count(*) AS n FROM reg_datasets GROUP BY owner_id, file_type) GROUP BY owner_id),
months AS (SELECT owner_id, string_agg(name || ':' || n, ',' ORDER BY m) AS uploads_per_month
  FROM (SELECT owner_id, month(uploaded_at) AS m, {MONTH_SQL} AS name, count(*) AS n FROM reg_datasets GROUP BY ALL) GROUP BY owner_id)
SELECT owner_id, count(*) AS total_datasets, count(analysis_id) AS total_analyses,
  round(coalesce(avg(quality_score), 0), 2) AS average_quality_score, sum(rows)::BIGINT AS total_rows,
  any_value(uploads_per_month) AS uploads_per_month, any_value(file_types) AS file_types,
  {" || ',' || ".join(f"'{name}:' || count(*) FILTER (WHERE {test})" for name, test in RANGES)} AS quality_distribution,
  string_agg(id::VARCHAR, ',' ORDER BY rd) FILTER (WHERE rd <= 5) AS recent_datasets,
  coalesce(string_agg(id::VARCHAR, ',' ORDER BY ra) FILTER (WHERE ra <= 5 AND analysis_id IS NOT NULL), '') AS recent_analyses
FROM ranked JOIN types USING (owner_id) JOIN months USING (owner_id) GROUP BY owner_id""".lstrip())),
}
