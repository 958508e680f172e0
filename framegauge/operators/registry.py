"""Queries over the registry of datasets and their analyses.

Datasets: id, owner_id, filename, original_filename, file_type, file_path,
file_size, rows, columns, uploaded_at.  Analyses: id, dataset_id (unique),
quality_score, created_at, plus profile sections.

Every query takes one owner, or none to answer for all owners at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegauge.functions.labels import SCORE_RANGES, month_name
from framegauge.operators.joins import BROADCAST_ROWS, SALTS, count_up_to, keyed_join

RECENT = 5
# Fixed value: the largest page of the dataset listing.
LISTING_PAGE_SIZE = 100
# Largest rank that Spark limits in every partition before the shuffle.
EARLY_RANKS = 1000
# Columns that a listing may be sorted by.
SORT_COLUMNS = ("uploaded_at", "rows", "columns", "file_size", "original_filename")


def owner_scope(df: DataFrame, owner: int | DataFrame | None) -> DataFrame:
    """Rows of one owner, of the owners in a frame, or all."""
    if owner is None:
        return df
    if isinstance(owner, DataFrame):
        owners = owner.select("owner_id").distinct()
        return keyed_join(df, owners, ["owner_id"], "left_semi", count_up_to(owners, BROADCAST_ROWS))
    return df.where(F.col("owner_id") == owner)


def _owner_keys(owner: int | None) -> list[str]:
    return ["owner_id"] if owner is None else []


def with_analysis(datasets: DataFrame, analyses: DataFrame, owner: int | None = None, how: str = "inner") -> DataFrame:
    """Datasets with the analysis of each; both sides are unique on the key."""
    scored = analyses.select(F.col("dataset_id").alias("id"), F.col("id").alias("analysis_id"),
                             "quality_score", "created_at")
    return owner_scope(datasets, owner).join(scored, "id", how)


def dataset_lookup(datasets: DataFrame, keys: DataFrame) -> DataFrame:
    """Datasets whose (id, owner_id) pair is asked for: the id alone is not enough."""
    return datasets.join(keys.select("id", "owner_id"), ["id", "owner_id"], "left_semi")


def find_dataset(datasets: DataFrame, dataset_id: int, owner: int) -> DataFrame:
    return datasets.where((F.col("id") == dataset_id) & (F.col("owner_id") == owner))


def analysis_lookup(analyses: DataFrame, datasets: DataFrame, keys: DataFrame) -> DataFrame:
    """Analyses of the datasets whose (id, owner_id) pair is asked for."""
    owned = dataset_lookup(datasets, keys).select(F.col("id").alias("dataset_id"))
    return analyses.join(owned, "dataset_id", "left_semi")


def find_analysis(analyses: DataFrame, datasets: DataFrame, dataset_id: int, owner: int) -> DataFrame:
    owned = find_dataset(datasets, dataset_id, owner).select(F.col("id").alias("dataset_id"))
    return analyses.where(F.col("dataset_id") == dataset_id).join(owned, "dataset_id", "left_semi")


def total_datasets(datasets: DataFrame, owner: int | None = None) -> DataFrame:
    return owner_scope(datasets, owner).groupBy(*_owner_keys(owner)).agg(F.count("id").alias("total_datasets"))


def total_rows(datasets: DataFrame, owner: int | None = None) -> DataFrame:
    return owner_scope(datasets, owner).groupBy(*_owner_keys(owner)).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))


def _mean_score() -> Column:
    return F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 2).alias("average_quality_score")


def total_analyses(datasets: DataFrame, analyses: DataFrame, owner: int | None = None) -> DataFrame:
    """Analysed datasets; an owner without any counts 0."""
    return with_analysis(datasets, analyses, owner, "left").groupBy(*_owner_keys(owner)).agg(
        F.count("analysis_id").alias("total_analyses"))


def average_quality(datasets: DataFrame, analyses: DataFrame, owner: int | None = None) -> DataFrame:
    return with_analysis(datasets, analyses, owner, "left").groupBy(*_owner_keys(owner)).agg(_mean_score())


def _newest(df: DataFrame, owner: int | None, time: str, tie: str, k: int) -> DataFrame:
    """The k newest rows, per owner if no owner is given, with their rank.

    The rank filter is applied inside every partition before the shuffle, so an
    owner with very many rows sends k of them.
    """
    order = [F.desc(time), F.desc(tie)]
    if owner is not None:
        df = df.orderBy(*order).limit(k)
    window = Window.partitionBy("owner_id").orderBy(*order)
    return df.withColumn("recent", F.row_number().over(window)).where(F.col("recent") <= k)


def recent_datasets(datasets: DataFrame, analyses: DataFrame, owner: int | None = None, k: int = RECENT) -> DataFrame:
    """Newest datasets with their score, null where not analysed.

    Ranks first: an analysis never adds or removes a dataset, so only the winners
    are joined.
    """
    newest = _newest(owner_scope(datasets, owner), owner, "uploaded_at", "id", k)
    scores = analyses.select(F.col("dataset_id").alias("id"), "quality_score")
    found = newest.join(scores, "id", "left").select(
        "owner_id", "recent", "id", "filename", "original_filename", "rows", "columns", "uploaded_at",
        "quality_score")
    return found if owner is None else found.orderBy("recent")


def recent_analyses(datasets: DataFrame, analyses: DataFrame, owner: int | None = None, k: int = RECENT) -> DataFrame:
    """Newest analyses with the name of their dataset."""
    joined = with_analysis(datasets.select("id", "owner_id", "original_filename"), analyses, owner)
    return _newest(joined, owner, "created_at", "analysis_id", k).select(
        "owner_id", "recent", "analysis_id", F.col("id").alias("dataset_id"),
        F.col("original_filename").alias("dataset_name"), "quality_score", "created_at")


def uploads_per_month(datasets: DataFrame, owner: int | None = None) -> DataFrame:
    """Uploads by calendar month, years merged; months without uploads are absent."""
    return (owner_scope(datasets, owner)
            .groupBy(*_owner_keys(owner), F.month("uploaded_at").alias("month_number"))
            .agg(F.count("id").alias("uploads"))
            .withColumn("month", month_name(F.col("month_number")))
            .orderBy(*_owner_keys(owner), "month_number"))


def file_type_distribution(datasets: DataFrame, owner: int | None = None) -> DataFrame:
    """Datasets by type; labels are upper-cased after grouping."""
    return (owner_scope(datasets, owner).groupBy(*_owner_keys(owner), "file_type")
            .agg(F.count("id").alias("count"))
            .withColumn("file_type", F.upper("file_type")))


def score_range_counts(score: Column) -> list[Column]:
    """One count per score range; a null score is in none."""
    counts, above = [], None
    for name, start in SCORE_RANGES:
        inside = score >= start if start is not None else score.isNotNull()
        counts.append(F.count_if(inside if above is None else inside & ~above).alias(name))
        above = score >= start if start is not None else above
    return counts


def score_range_rows() -> Column:
    """The five ranges in order, as rows, from the counts of ``score_range_counts``."""
    return F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("range"), F.col(f"`{name}`").alias("count"))
        for i, (name, _) in enumerate(SCORE_RANGES)]))


def quality_distribution(datasets: DataFrame, analyses: DataFrame, owner: int | None = None) -> DataFrame:
    """Analyses by score range; all five ranges, empty ones with 0."""
    keys = _owner_keys(owner)
    scored = with_analysis(datasets, analyses, owner, "left")
    return scored.groupBy(*keys).agg(*score_range_counts(F.col("quality_score"))).select(*keys, score_range_rows())


def search_datasets(datasets: DataFrame, search: str | None) -> DataFrame:
    """Case-insensitive search in the name; % and _ in the input are wildcards."""
    if not search:
        return datasets
    pattern = search.replace("\\", "\\\\")
    return datasets.where(F.col("original_filename").ilike(f"%{pattern}%"))


def sort_order(sort_by: str, order: str) -> list[Column]:
    """Order of a listing, ties by id."""
    column = sort_by if sort_by in SORT_COLUMNS else "uploaded_at"
    return ([F.asc(column), F.asc("id")] if order.lower() == "asc" else [F.desc(column), F.desc("id")])


def sort_datasets(datasets: DataFrame, sort_by: str = "uploaded_at", order: str = "desc") -> DataFrame:
    """Sorted by a known column, else by upload time; anything but "asc" descends."""
    return datasets.orderBy(*sort_order(sort_by, order))


def check_page(page: int, page_size: int, largest: int | None = None) -> None:
    if page < 1:
        raise ValueError("page starts at 1")
    if page_size < 1 or largest is not None and page_size > largest:
        raise ValueError(f"page_size is 1 to {largest}" if largest else "page_size starts at 1")


def page_datasets(
    datasets: DataFrame, page: int = 1, page_size: int = 10, sort_by: str = "uploaded_at", order: str = "desc",
) -> DataFrame:
    """One page of an owner's datasets; deep ones of many rows are for ``rank_directory``."""
    check_page(page, page_size)
    return sort_datasets(datasets, sort_by, order).offset((page - 1) * page_size).limit(page_size)


def page_per_owner(
    datasets: DataFrame, page: int = 1, page_size: int = 10, sort_by: str = "uploaded_at", order: str = "desc",
) -> DataFrame:
    """The same page of every owner, with each row's place in the owner's list."""
    check_page(page, page_size)
    by, last = sort_order(sort_by, order), page * page_size
    if last > EARLY_RANKS:
        # The first rows of an owner are among the first of each share of the owner's rows.
        share = Window.partitionBy("owner_id", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(*by)
        datasets = datasets.withColumn("__near", F.row_number().over(share)).where(
            F.col("__near") <= last).drop("__near")
    window = Window.partitionBy("owner_id").orderBy(*by)
    return (datasets.withColumn("place", F.row_number().over(window))
            .where(F.col("place") <= last)
            .where(F.col("place") > (page - 1) * page_size))


def page_after(datasets: DataFrame, last_value, last_id: int, page_size: int = 10, sort_by: str = "uploaded_at",
               order: str = "desc") -> DataFrame:
    """The page after a known row: reads no skipped rows, however deep.

    Rows without a value come last when descending and first when ascending, as in
    the sort; ``last_value`` is None after such a row.
    """
    check_page(1, page_size)
    column = F.col(sort_by if sort_by in SORT_COLUMNS else "uploaded_at")
    up = order.lower() == "asc"
    later_id = F.col("id") > last_id if up else F.col("id") < last_id
    if last_value is None:
        beyond = column.isNull() & later_id
        if up:
            beyond = beyond | column.isNotNull()
    else:
        value = F.lit(last_value)
        beyond = (column > value if up else column < value) | ((column == value) & later_id)
        if not up:
            beyond = beyond | column.isNull()
    return sort_datasets(datasets.where(beyond), sort_by, order).limit(page_size)


def page_meta(datasets: DataFrame, page: int = 1, page_size: int = 10, per_owner: bool = False) -> DataFrame:
    """Total before paging and number of pages, 1 if there is nothing."""
    check_page(page, page_size)
    keys = ["owner_id"] if per_owner else []
    return datasets.groupBy(*keys).agg(F.count("id").alias("total")).select(
        *keys, "total", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
        F.greatest(F.ceil(F.col("total") / page_size), F.lit(1)).cast("bigint").alias("pages"))


def list_datasets(
    datasets: DataFrame, owner: int, page: int = 1, page_size: int = 10, search: str | None = None,
    sort_by: str = "uploaded_at", order: str = "desc",
) -> tuple[DataFrame, DataFrame]:
    """Items of one page and the page's metadata."""
    check_page(page, page_size, LISTING_PAGE_SIZE)
    found = search_datasets(owner_scope(datasets, owner), search)
    return page_datasets(found, page, page_size, sort_by, order), page_meta(found, page, page_size)


def rename_dataset(datasets: DataFrame, names: DataFrame) -> DataFrame:
    """New version of the table with names replaced from (id, owner_id, new_name).

    Only the owner's own datasets are renamed.
    """
    latest = names.groupBy("id", "owner_id").agg(F.max("new_name").alias("new_name"))
    return (datasets.join(latest, ["id", "owner_id"], "left")
            .withColumn("original_filename", F.coalesce("new_name", "original_filename"))
            .select(*datasets.columns))


def delete_dataset(datasets: DataFrame, analyses: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions of both tables without the datasets of (id, owner_id); files are kept.

    Only the owner's own datasets are deleted.
    """
    gone = dataset_lookup(datasets, ids).select("id")
    return (datasets.join(gone, "id", "left_anti"),
            analyses.join(gone.withColumnRenamed("id", "dataset_id"), "dataset_id", "left_anti"))


def user_datasets(datasets: DataFrame, owner: int | None = None) -> DataFrame:
    """All datasets of an owner, newest first; of every owner in turn if none is given."""
    return owner_scope(datasets, owner).orderBy(*_owner_keys(owner), F.desc("uploaded_at"), F.desc("id"))


def user_lookup(frame: DataFrame, users: DataFrame, by: str = "email", frame_key: str | None = None) -> DataFrame:
    """``frame`` with the user of each row, found by email or id; null where unknown."""
    picked = users.select(F.col(by).alias("__user"), F.col("id").alias("user_id"), "full_name",
                          *([] if by == "email" else ["email"]))
    count = count_up_to(picked, BROADCAST_ROWS)
    key = frame_key or by
    return keyed_join(frame.withColumn("__user", F.col(key)), picked, ["__user"], "left", count).drop("__user")


def new_user_check(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates with ``accepted``: the email is new, and first in the batch by id.

    Emails meet existing users after they are reduced to one row each, and the
    verdict returns to the candidates by their unique id, so a frequent email
    stays spread out.
    """
    firsts = candidates.groupBy("email").agg(F.min("id").alias("id"))
    accepted = firsts.join(users.select("email"), "email", "left_anti").select("id", F.lit(True).alias("accepted"))
    return candidates.join(accepted, "id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
