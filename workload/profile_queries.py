"""Profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from framegauge.functions.columns import column_dtypes, numeric_columns
from framegauge.operators import column_profile as cp
from framegauge.operators import profile_states as ps
from framegauge.operators.correlation import correlation_matrix
from framegauge.operators.duplicates import duplicate_rows
from framegauge.plans.table_profile import group_scores, profile_by_group, profile_table
from framegauge.session import scratch_path
from workload import fixtures as fx

DIGITS = 6


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, DIGITS))
    return df


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def table_shape(spark, sf):
    return cp.table_shape(fx.docs_labeled(spark, sf))


def estimated_bytes(spark, sf):
    return cp.estimated_bytes(fx.table(spark, sf, "documents"))


def missing_cells(spark, sf):
    return cp.missing_cells(fx.lineitem_gaps(spark, sf))


def duplicates(spark, sf):
    return duplicate_rows(fx.events_dup(spark, sf))


def duplicates_documents(spark, sf):
    """Documents as wide rows, every seventh there twice: only digests are shuffled."""
    docs = fx.table(spark, sf, "documents")
    return duplicate_rows(docs.unionByName(docs.where(F.col("doc_id") % 7 == 0)))


def duplicates_wide(spark, sf):
    return duplicate_rows(fx.events_twice(spark, sf))


def dtypes(spark, sf):
    return column_dtypes(fx.docs_labeled(spark, sf)).select("column", "kind")


def column_missing(spark, sf):
    nan = cp.column_missing(fx.nan_col(spark, sf)).withColumn("source", F.lit("nan_col"))
    return cp.column_missing(fx.docs_labeled(spark, sf)).withColumn("source", F.lit("docs_labeled")).unionByName(nan)


def _halves(df, by, states, merge, keys=()):
    """States of the even and of the odd rows, stored apart and put together when read."""
    path = scratch_path(df.sparkSession, "states")
    for odd in (0, 1):
        states(df.where(F.col(by) % 2 == odd), keys).write.mode("append").parquet(path)
    return merge(df.sparkSession.read.parquet(path), keys)


# Standard errors that an estimate may be off by.
ERRORS = 4


def profile_states(spark, sf):
    """Events by type, profiled as two halves that are merged; estimates are held against exact counts."""
    events = fx.table(spark, sf, "events").drop("ts")
    merged = ps.profile_of_states(_halves(events, "event_id", ps.column_states, ps.merge_column_states, ("event_type",)), ("event_type",))
    exact = cp.column_unique(events, ("event_type",)).withColumnRenamed("unique", "exact")
    near = F.abs(F.col("unique") - F.col("exact")) <= ERRORS * ps.unique_error() * F.col("exact") + 1
    found = merged.join(exact, ["event_type", "column"]).select(
        "event_type", "column", "rows", "missing", "missing_percent", "count", F.col("exact").alias("unique"), near.alias("estimate_near"),
        "mean", "std", "min", "max")
    return rounded(found, "mean", "std", "min", "max")


def correlation_states(spark, sf):
    """Correlations of line items from two halves that are merged."""
    lines = fx.lineitem_gaps(spark, sf)
    return ps.correlations_of_states(_halves(lines, "l_orderkey", ps.pair_states, ps.merge_pair_states))


def column_unique_estimate(spark, sf):
    """Distinct values by sketch, with whether each estimate is as near to the exact count as promised."""
    lines = fx.lineitem_gaps(spark, sf)
    joined = cp.column_unique_estimate(lines, UNIQUE_ERROR).withColumnRenamed("unique", "estimate").join(cp.column_unique(lines), "column")
    return joined.select("column", "unique", (F.abs(F.col("estimate") - F.col("unique")) <= ERRORS * UNIQUE_ERROR * F.col("unique") + 1).alias("near"))


UNIQUE_ERROR = 0.02


def column_unique(spark, sf):
    return cp.column_unique(fx.lineitem_gaps(spark, sf))


def describe_numeric(spark, sf):
    return rounded(cp.describe_numeric(fx.lineitem_gaps(spark, sf)), "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_categorical(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") > 100000).alias("expensive"))
    return cp.describe_categorical(orders)


def describe_temporal(spark, sf):
    found = cp.describe_temporal(fx.table(spark, sf, "events").select("ts"))
    times = ("mean", "min", "q25", "q50", "q75", "max")
    return found.select("column", "count", *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in times])


def describe_all(spark, sf):
    found = cp.describe_all(fx.docs_labeled(spark, sf))
    return rounded(found, "value").select(
        "column", "metric", "value", F.when(F.col("metric") == "top", F.col("text")).alias("text"))


def numeric(spark, sf):
    return numeric_columns(fx.table(spark, sf, "events"))


def correlations(spark, sf):
    gaps = correlation_matrix(fx.lineitem_gaps(spark, sf)).withColumn("source", F.lit("lineitem_gaps"))
    return gaps.unionByName(correlation_matrix(fx.const_col(spark, sf)).withColumn("source", F.lit("const_col")))


# The numbers of line items and the products of any two of them.
PRODUCTS = {f"{a}_{b}": (a, b) for a, b in combinations(fx.LINEITEM_NUMBERS, 2)}
WIDE_NUMBERS = [*fx.LINEITEM_NUMBERS, *PRODUCTS]


def correlation_by_group(spark, sf):
    """Correlations of 36 columns by return flag."""
    lines = fx.lineitem_gaps(spark, sf)
    products = [(F.col(a).cast("double") * F.col(b)).alias(name) for name, (a, b) in PRODUCTS.items()]
    return correlation_matrix(lines.select("l_returnflag", *fx.LINEITEM_NUMBERS, *products), ("l_returnflag",))


def _grouped_corr_sql(source: str, key: str, columns: list[str]) -> str:
    """Every pair is an aggregate of one scan, laid out in rows afterwards."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggregates = ", ".join(f'coalesce(corr({a}::DOUBLE, {b}::DOUBLE), 0) AS "{a}|{b}"' for a, b in pairs)
    return (f"WITH {fx.LINEITEM_GAPS}, w AS (SELECT *, " + ", ".join(f"{a}::DOUBLE * {b} AS {n}" for n, (a, b) in PRODUCTS.items())
            + f" FROM {source}), wide AS (SELECT {key}, {aggregates} FROM w GROUP BY {key}), "
            f"pairs AS (UNPIVOT wide ON COLUMNS(* EXCLUDE {key}) INTO NAME pair VALUE r), named AS ("
            f"SELECT {key}, split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, "
            "round(CASE WHEN isnan(r) THEN 0 ELSE r END, 3) + 0.0::DOUBLE AS corr FROM pairs) "
            f"SELECT {key}, a AS x, b AS y, corr FROM named UNION ALL SELECT {key}, b, a, corr FROM named WHERE a <> b")


def iqr_quartiles(spark, sf):
    return rounded(cp.iqr_quartiles(fx.lineitem_gaps(spark, sf)), "q25", "q75")


def iqr_fences(spark, sf):
    return rounded(cp.iqr_fences(fx.table(spark, sf, "events")), "iqr", "lower", "upper")


def iqr_outliers(spark, sf):
    return cp.iqr_outliers(fx.docs_labeled(spark, sf))


def outlier_rows(spark, sf):
    return cp.outlier_rows(fx.table(spark, sf, "events"), "value")


def quality_score(spark, sf):
    return group_scores(fx.lineitem_gaps(spark, sf), "l_orderkey")


def summary_text(spark, sf):
    return profile_table(fx.docs_labeled(spark, sf)).summary().select("rows", "summary_text")


def whole_profile(spark, sf):
    return rounded(profile_table(fx.docs_labeled(spark, sf)).long(), "value")


def group_profile(spark, sf):
    return rounded(profile_by_group(fx.table(spark, sf, "events"), "event_type").long(), "value")


def _missing_sql(source: str, columns: list[str], extra: str = "") -> str:
    return union(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent{extra} FROM {source}"
        for c in columns)


def _numeric_sql(source: str, columns: list[str], group: str = "") -> str:
    def one(c):
        stats = ", ".join(f"round({e}, {DIGITS}) AS {n}" for n, e in (
            ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})::DOUBLE"),
            ("q25", f"quantile_cont({c}, 0.25)"), ("q50", f"quantile_cont({c}, 0.5)"),
            ("q75", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})::DOUBLE")))
        return f"SELECT '{c}' AS \"column\", count({c}) AS count, {stats} FROM {source}"
    return union(one(c) for c in columns)


def _corr_sql(source: str, columns: list[str], extra: str = "") -> str:
    return union(
        f"SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN isnan(corr({a}::DOUBLE, {b}::DOUBLE)) THEN 0 "
        f"ELSE coalesce(corr({a}::DOUBLE, {b}::DOUBLE), 0) END, 3) + 0.0::DOUBLE AS corr{extra} FROM {source}"
        for a in columns for b in columns)


def _top_sql(source: str, column: str, what: str, group: str = "", key: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    by = f"{group}, " if group else ""
    return (f"SELECT {key}{what} FROM (SELECT {by}v, n, row_number() OVER ({part}ORDER BY n DESC, v) AS rn FROM ("
            f"SELECT {by}{column}::VARCHAR AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL "
            f"GROUP BY {by}{column})) WHERE rn = 1")


def _outlier_sql(source: str, c: str) -> str:
    fence = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})"
    return (f"SELECT count(*) FILTER (WHERE {c} < q1 - (q3 - q1) * 1.5 OR {c} > q3 + (q3 - q1) * 1.5) "
            f"FROM {source}, {fence}")


def _profile_long_sql(source: str, bytes_of: dict[str, str], numbers: list[str], texts: list[str]) -> str:
    """(section, name, metric, value, text) of one table, piece by piece."""
    def row(section, name, metric, value, text="NULL"):
        return (f"SELECT '{section}' AS section, '{name}' AS name, '{metric}' AS metric, "
                f"round(({value})::DOUBLE, {DIGITS}) AS value, ({text})::VARCHAR AS text")
    columns = list(bytes_of)
    total = f"(SELECT count(*) FROM {source})"
    rows = [row("summary", "table", "rows", total), row("summary", "table", "columns", len(columns)),
            row("summary", "table", "memory_usage", " + ".join(f"(SELECT {b} FROM {source})" for b in bytes_of.values())),
            row("summary", "table", "missing_cells",
                "SELECT " + " + ".join(f"count(*) - count({c})" for c in columns) + f" FROM {source}"),
            row("summary", "table", "duplicate_rows", f"{total} - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))")]
    for c, b in bytes_of.items():
        rows += [row("column_info", c, "missing", f"SELECT count(*) - count({c}) FROM {source}"),
                 row("column_info", c, "missing_percent",
                     f"SELECT round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) FROM {source}"),
                 row("column_info", c, "unique", f"SELECT count(DISTINCT {c}) FROM {source}"),
                 row("column_info", c, "bytes", f"SELECT {b} FROM {source}")]
    for c in columns:
        number = c in numbers
        exprs = {"count": f"count({c})"}
        if number:
            exprs |= {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "25%": f"quantile_cont({c}, 0.25)",
                      "50%": f"quantile_cont({c}, 0.5)", "75%": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}
        else:
            exprs |= {"unique": f"count(DISTINCT {c})"}
        for metric in cp.METRICS:
            if metric == "top" and not number:
                rows.append(row("statistics", c, metric, "NULL", _top_sql(source, c, "v")))
            elif metric == "freq" and not number:
                rows.append(row("statistics", c, metric, _top_sql(source, c, "n")))
            else:
                rows.append(row("statistics", c, metric, f"SELECT {exprs[metric]} FROM {source}" if metric in exprs else "NULL"))
    for a in numbers:
        for b in numbers:
            rows.append(row("correlations", a, b,
                            f"SELECT round(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE coalesce(corr({a}, {b}), 0) END, 3) "
                            f"+ 0.0::DOUBLE FROM {source}"))
        rows.append(row("outliers", a, "outliers", _outlier_sql(source, a)))
    return union(rows)


DOCS_BYTES = {"doc_id": "8 * count(doc_id)", "text": "sum(strlen(text))", "lang": "sum(strlen(lang))", "source": "sum(strlen(source))",
              "n_chars": "8 * count(n_chars)", "quality": "{w} * count(quality)", "toxic": "{w} * count(toxic)"}


def docs_bytes() -> dict[str, str]:
    # Labels are stored as bigint in some deliveries and as int in others.
    width = "(CASE WHEN any_value(typeof({c})) = 'BIGINT' THEN 8 ELSE 4 END)"
    return {c: e.replace("{w}", width.replace("{c}", c)) for c, e in DOCS_BYTES.items()}


def _group_long_sql() -> str:
    src, key = "events", "event_type"
    numbers = ["event_id", "user_id", "value"]
    columns = {"event_id": "8", "ts": "8", "user_id": "8", "value": "8", "props": None}
    size = {c: f"sum(strlen({c}))" if w is None else f"{w} * count({c})" for c, w in columns.items()}
    parts = []

    def row(section, name, metric, value, frm=src):
        parts.append(f"SELECT {key}, '{section}' AS section, '{name}' AS name, '{metric}' AS metric, "
                     f"round(({value})::DOUBLE, {DIGITS}) AS value, NULL::VARCHAR AS text FROM {frm} GROUP BY {key}")
    row("summary", "table", "rows", "count(*)")
    row("summary", "table", "columns", str(len(columns)))
    row("summary", "table", "memory_usage", " + ".join(size.values()))
    row("summary", "table", "missing_cells", " + ".join(f"count(*) - count({c})" for c in columns))
    row("summary", "table", "duplicate_rows", "sum(n - 1)", f"(SELECT *, count(*) AS n FROM {src} GROUP BY ALL)")
    for c in columns:
        row("column_info", c, "missing", f"count(*) - count({c})")
        row("column_info", c, "missing_percent", f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2)")
        row("column_info", c, "unique", f"count(DISTINCT {c})")
        row("column_info", c, "bytes", size[c])
        if c not in numbers:
            best = (f"(SELECT {key}, {c}, count(*) AS n FROM {src} GROUP BY {key}, {c} "
                    f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {c}) = 1)")
            exprs = {"count": f"count({c})"} | ({"unique": f"count(DISTINCT {c})"} if c == "props" else {})
            for metric in cp.METRICS:
                if c == "props" and metric == "freq":
                    row("statistics", c, metric, "any_value(n)", best)
                elif c == "props" and metric == "top":
                    parts.append(f"SELECT {key}, 'statistics' AS section, '{c}' AS name, 'top' AS metric, NULL::DOUBLE AS value, "
                                 f"{c} AS text FROM {best}")
                else:
                    row("statistics", c, metric, exprs.get(metric, "NULL"))
            continue
        exprs = {"count": f"count({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})",
                 "25%": f"quantile_cont({c}, 0.25)", "50%": f"quantile_cont({c}, 0.5)",
                 "75%": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}
        for metric in cp.METRICS:
            row("statistics", c, metric, exprs.get(metric, "NULL"))
        for b in numbers:
            row("correlations", c, b, f"round(CASE WHEN isnan(corr({c}, {b})) THEN 0 ELSE coalesce(corr({c}, {b}), 0) END, 3) + 0.0::DOUBLE")
        row("outliers", c, "outliers", f"count(*) FILTER (WHERE {c} < q1 - (q3 - q1) * 1.5 OR {c} > q3 + (q3 - q1) * 1.5)",
            f"{src} JOIN (SELECT {key}, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src} GROUP BY {key}) USING ({key})")
    return union(parts)


_SIZE = " + ".join(f"(SELECT {e} FROM docs_labeled)" for e in docs_bytes().values())
_MISSING = " + ".join(f"count(*) - count({c})" for c in fx.DOCS_COLUMNS)

ENTRIES = {
    "table_shape": (table_shape, f"WITH {fx.DOCS_LABELED} SELECT count(*) AS rows, 7::BIGINT AS columns FROM docs_labeled"),
    "estimated_bytes": (estimated_bytes, union([
        "SELECT 'doc_id' AS \"column\", 8 * count(doc_id) AS bytes FROM documents",
        *[f"SELECT '{c}', sum(strlen({c}))::BIGINT FROM documents" for c in ("text", "lang", "source")],
        "SELECT 'n_chars', 8 * count(n_chars) FROM documents"])),
    "missing_cells": (missing_cells, f"WITH {fx.LINEITEM_GAPS} SELECT "
                      + " + ".join(f"count(*) - count({c})" for c in fx.LINEITEM_COLUMNS)
                      + " AS missing_cells FROM lineitem_gaps"),
    "duplicate_rows": (duplicates, "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events)) "
                       "AS duplicate_rows FROM events"),
    "duplicate_rows_documents": (duplicates_documents, "WITH d AS (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 7 = 0) "
                                 "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows FROM d"),
    "duplicate_rows_wide": (duplicates_wide, "WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 7 = 0) "
                            "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS duplicate_rows FROM e"),
    "column_dtypes": (dtypes, "SELECT column_name AS \"column\", CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE 'integer' END AS kind "
                      "FROM (SELECT * FROM (DESCRIBE documents) UNION ALL SELECT * FROM (DESCRIBE labels) WHERE column_name <> 'doc_id')"),
    "column_missing": (column_missing, f"WITH {fx.DOCS_LABELED}, {fx.NAN_COL}\n"
                       + _missing_sql("docs_labeled", fx.DOCS_COLUMNS, ", 'docs_labeled' AS source") + "\nUNION ALL\n"
                       + _missing_sql("nan_col", ["doc_id", "lang", "length"], ", 'nan_col' AS source")),
    "column_unique": (column_unique, f"WITH {fx.LINEITEM_GAPS}\n" + union(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\" FROM lineitem_gaps" for c in fx.LINEITEM_COLUMNS)),
    "column_unique_estimate": (column_unique_estimate, f"WITH {fx.LINEITEM_GAPS}\n" + union(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\", true AS near FROM lineitem_gaps" for c in fx.LINEITEM_COLUMNS)),
    "profile_states": (profile_states, union(
        f"SELECT event_type, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
        f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent, count({c}) AS count, count(DISTINCT {c}) AS \"unique\", "
        f"true AS estimate_near, " + ", ".join(f"round({e}, 6) AS {n}" if numeric_column else f"NULL::DOUBLE AS {n}" for n, e in (
            ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})::DOUBLE"), ("max", f"max({c})::DOUBLE")))
        + " FROM events GROUP BY event_type"
        for c, numeric_column in (("event_id", True), ("user_id", True), ("value", True), ("props", False)))),
    "correlation_states": (correlation_states, f"WITH {fx.LINEITEM_GAPS}\n" + _corr_sql("lineitem_gaps", fx.LINEITEM_NUMBERS)),
    "describe_numeric": (describe_numeric, f"WITH {fx.LINEITEM_GAPS}\n" + _numeric_sql("lineitem_gaps", fx.LINEITEM_NUMBERS)),
    "describe_categorical": (describe_categorical,
        "WITH o AS (SELECT o_orderstatus, o_orderpriority, o_totalprice > 100000 AS expensive FROM orders)\n" + union(
            f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM o) AS count, (SELECT count(DISTINCT {c}) FROM o) AS \"unique\", "
            f"({_top_sql('o', c, 'v')}) AS top, ({_top_sql('o', c, 'n')}) AS freq"
            for c in ("o_orderstatus", "o_orderpriority", "expensive"))),
    "describe_temporal": (describe_temporal, "SELECT 'ts' AS \"column\", count(ts) AS count, " + ", ".join(
        f"strftime(make_timestamp(round({e})::BIGINT), '%Y-%m-%dT%H:%M:%S') AS {n}" for n, e in (
            ("mean", "avg(us)"), ("min", "min(us)"), ("q25", "quantile_cont(us, 0.25)"), ("q50", "quantile_cont(us, 0.5)"),
            ("q75", "quantile_cont(us, 0.75)"), ("max", "max(us)"))) + " FROM (SELECT ts, epoch_us(ts) AS us FROM events)"),
    "describe_all": (describe_all, f"WITH {fx.DOCS_LABELED}, p AS (\n"
                     + _profile_long_sql("docs_labeled", docs_bytes(), fx.DOCS_NUMBERS, fx.DOCS_TEXTS)
                     + ") SELECT name AS \"column\", metric, value, text FROM p WHERE section = 'statistics'"),
    "numeric_columns": (numeric, "SELECT event_id, user_id, value FROM events"),
    "correlation_matrix": (correlations, f"WITH {fx.LINEITEM_GAPS}, const_col AS (SELECT user_id, value, 1.0::DOUBLE AS constant FROM events)\n"
                           + _corr_sql("lineitem_gaps", fx.LINEITEM_NUMBERS, ", 'lineitem_gaps' AS source") + "\nUNION ALL\n"
                           + _corr_sql("const_col", ["user_id", "value", "constant"], ", 'const_col' AS source")),
    "correlation_by_group": (correlation_by_group, _grouped_corr_sql("lineitem_gaps", "l_returnflag", WIDE_NUMBERS)),
    "iqr_quartiles": (iqr_quartiles, f"WITH {fx.LINEITEM_GAPS}\n" + union(
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.75), 6) AS q75 "
        "FROM lineitem_gaps" for c in fx.LINEITEM_NUMBERS)),
    "iqr_fences": (iqr_fences, union(
        f"SELECT '{c}' AS \"column\", round(q3 - q1, 6) AS iqr, round(q1 - (q3 - q1) * 1.5, 6) AS lower, "
        f"round(q3 + (q3 - q1) * 1.5, 6) AS upper FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events)"
        for c in ("event_id", "user_id", "value"))),
    "iqr_outliers": (iqr_outliers, f"WITH {fx.DOCS_LABELED}\n" + union(
        f"SELECT '{c}' AS \"column\", ({_outlier_sql('docs_labeled', c)}) AS outliers" for c in fx.DOCS_NUMBERS)),
    "outlier_rows": (outlier_rows, "SELECT events.* FROM events, "
                     "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) "
                     "WHERE value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5"),
    "quality_score": (quality_score, f"WITH {fx.SCORED_ORDERS} SELECT * FROM scored_orders"),
    "summary_text": (summary_text, f"""WITH {fx.DOCS_LABELED}, s AS (
  SELECT count(*) AS n, {_MISSING} AS m, ({_SIZE})::BIGINT AS b,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM docs_labeled)) AS d FROM docs_labeled)
SELECT n AS rows, 'The dataset contains ' || format('{{:,}}', n) || ' rows and 7 columns. It occupies approximately '
  || printf('%.2f', b / 1024.0::DOUBLE) || ' KB of memory. '
  || CASE WHEN m = 0 THEN 'No missing values were detected.' ELSE 'There are ' || m || ' missing values in the dataset.' END || ' '
  || CASE WHEN d = 0 THEN 'No duplicate rows were found.' ELSE d || ' duplicate rows were detected.' END AS summary_text
FROM s"""),
    "profile_table": (whole_profile, f"WITH {fx.DOCS_LABELED}\n"
                      + _profile_long_sql("docs_labeled", docs_bytes(), fx.DOCS_NUMBERS, fx.DOCS_TEXTS)),
    "profile_by_group": (group_profile, _group_long_sql()),
}
