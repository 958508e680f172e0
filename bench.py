"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from itertools import combinations
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F

from framegauge.operators import column_profile as cp
from framegauge.operators.correlation import correlation_matrix
from framegauge.operators.duplicates import duplicate_rows
from framegauge.plans.table_profile import group_scores, profile_table
from framegauge.session import local_session
from workload import ENTRIES
from workload import fixtures as fx


def lineitem(query):
    return lambda spark, sf: query(fx.table(spark, sf, "lineitem"))


# Probes on the full width of lineitem, then registered queries.
PROBES = {
    "quartiles_8_columns": lineitem(cp.iqr_quartiles),
    "outliers_8_columns": lineitem(cp.iqr_outliers),
    "unique_11_columns": lineitem(cp.column_unique),
    "unique_estimate_11_columns": lineitem(cp.column_unique_estimate),
    "duplicates_11_columns": lineitem(duplicate_rows),
    "correlation_28_pairs": lineitem(correlation_matrix),
    "describe_lineitem": lineitem(cp.describe_all),
    "profile_lineitem": lineitem(lambda df: profile_table(df).long()),
    "registry_build": fx.reg_analyses,
    "scores_per_order": lambda spark, sf: group_scores(fx.lineitem_gaps(spark, sf), "l_orderkey"),
}
NUMBERS = fx.LINEITEM_NUMBERS

# The same questions as one plain aggregate each, for comparison on this machine;
# not part of the total.
PLAIN = {
    "quartiles_8_columns": lineitem(lambda df: df.agg(*[F.percentile(c, [0.25, 0.5, 0.75]) for c in NUMBERS])),
    "unique_11_columns": lineitem(lambda df: df.agg(*[F.count_distinct(c) for c in df.columns])),
    "unique_estimate_11_columns": lineitem(lambda df: df.agg(*[F.approx_count_distinct(c) for c in df.columns])),
    "duplicates_11_columns": lineitem(
        lambda df: df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1).alias("d"))),
    "correlation_28_pairs": lineitem(lambda df: df.agg(*[F.corr(a, b) for a, b in combinations(NUMBERS, 2)])),
}
REGISTERED = ("column_missing", "describe_categorical", "profile_by_group", "recent_datasets", "quality_distribution",
              "dashboard", "csv_scan", "ingest_stream")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="framegauge-bench")
    chosen = {**PROBES, **{name: ENTRIES[name][0] for name in REGISTERED}}
    only = sys.argv[1:]
    # The first run of a query pays for class loading and code generation, so each
    # runs once on the smallest tables, if they are there, before it is timed.
    small = Path(sf).parent / "sf0.001"
    times, plain, warmed = {}, {}, small.is_dir()

    def run(query, folder):
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name, query in chosen.items():
        if only and name not in only:
            continue
        if warmed:
            run(query, str(small))
        times[name] = run(query, sf)
        if name in PLAIN:
            if warmed:
                run(PLAIN[name], str(small))
            plain[name] = run(PLAIN[name], sf)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf).name.removeprefix("sf"), "warmed": warmed,
                      "plain_aggregates": plain}))
    spark.stop()


if __name__ == "__main__":
    main()
