"""Shapes of the physical plans that matter at scale."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framegauge import session
from framegauge.operators import column_profile as cp
from framegauge.operators import joins, quantiles
from framegauge.operators import registry as rg
from framegauge.operators.correlation import correlation_matrix
from framegauge.operators.duplicates import duplicate_rows
from framegauge.plans import table_profile
from framegauge.plans.table_profile import group_scores, profile_table
from workload import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def assert_no_cross_join(text):
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_the_columns_asked_for(spark):
    text = plan(cp.outlier_rows(fx.table(spark, SF, "events").select("event_id", "value"), "value"))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    assert "props" not in text


def test_owner_filter_reaches_the_scan(spark):
    datasets = fx.table(spark, SF, "orders").withColumnsRenamed({"o_custkey": "owner_id", "o_orderkey": "id"})
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,5)]" in plan(rg.owner_scope(datasets, 5))


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(rg.recent_datasets(fx.reg_datasets(spark, SF), fx.reg_analyses(spark, SF)))
    assert "WindowGroupLimit" in text
    assert "WindowGroupLimit" in plan(rg.page_per_owner(fx.reg_datasets(spark, SF), 2, 10))


def test_no_cross_joins(spark):
    lines = fx.lineitem_gaps(spark, SF)
    for df in (cp.column_profile(lines), correlation_matrix(lines), duplicate_rows(lines), group_scores(lines, "l_orderkey"),
               rg.quality_distribution(fx.reg_datasets(spark, SF), fx.reg_analyses(spark, SF))):
        assert_no_cross_join(plan(df))


def test_missing_counts_shuffle_no_rows(spark):
    text = plan(cp.column_counts(fx.lineitem_gaps(spark, SF)))
    assert "hashpartitioning" not in text and "SinglePartition" in text


def test_many_columns_are_correlated_without_an_expand(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(300, 300)), columns=[f"c{i}" for i in range(300)])
    pdf["c1"] = pdf["c0"] * 2 + 1e9
    pdf.loc[::3, "c2"] = np.nan
    pdf.loc[0, "c4"] = np.inf
    pdf.loc[:1, "c6"] = np.nan
    pdf["c3"], pdf["c5"] = 0.1, np.nan
    df = spark.createDataFrame(pdf).repartition(3)
    frame = correlation_matrix(df)
    assert plan(frame).count("Expand") <= 1
    got = {(r["x"], r["y"]): r["corr"] for r in frame.collect()}
    assert len(got) == 300 * 300
    want = pdf.drop(columns="c4").corr().round(3).fillna(0.0)
    wrong = [(a, b) for a in want for b in want if abs(got[a, b] - want.loc[a, b]) > 0.0011]
    assert not wrong, wrong[:5]
    assert got["c4", "c4"] == got["c4", "c0"] == 0.0 and got["c3", "c3"] == got["c5", "c5"] == 0.0
    few = df.select([f"c{i}" for i in range(8)])
    narrow = {(r["x"], r["y"]): r["corr"] for r in correlation_matrix(few).collect()}
    assert all(abs(narrow[k] - got[k]) < 0.0011 for k in narrow)


def test_correlations_reuse_the_counts_of_a_profile(spark):
    lines = fx.lineitem_gaps(spark, SF)
    assert plan(cp.column_counts(lines)).count("Location:") == 1
    counts = session.checkpointed(cp.column_profile(lines))
    reused = correlation_matrix(lines, (), counts)
    assert plan(reused).count("Location:") <= 2 < plan(correlation_matrix(lines)).count("Location:")
    assert sorted(map(tuple, reused.collect())) == sorted(map(tuple, correlation_matrix(lines).collect()))


def test_both_ways_of_scoring_groups_agree(spark, monkeypatch):
    lines = fx.lineitem_gaps(spark, SF)
    first = sorted(map(tuple, group_scores(lines, "l_orderkey").collect()))
    monkeypatch.setattr(table_profile, "ARRAY_ROWS", 0)
    assert first == sorted(map(tuple, group_scores(lines, "l_orderkey").collect()))


def test_signed_zeros_are_one_value_on_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([("a", v) for v in (0.0, -0.0, 1.0, 2.0)], "g string, v double")
    for limit in (50_000, 2):
        monkeypatch.setattr(quantiles, "ARRAY_ROWS", limit)
        assert cp.order_profile(df, ("g",)).first()["unique"] == 3
    assert cp.column_unique(df).where("column = 'v'").first()["unique"] == 3


def test_tables_without_a_column_of_a_kind(spark):
    for schema, row in (("t string", ("x",)), ("n bigint", (1,)), ("d timestamp", (None,))):
        df = spark.createDataFrame([row], schema)
        for found in (cp.describe_numeric, cp.describe_categorical, cp.describe_temporal, cp.describe_all, cp.iqr_quartiles,
                      cp.iqr_fences, cp.iqr_outliers):
            found(df).collect()
        assert profile_table(df).summary().first()["rows"] == 1
    assert cp.describe_numeric(spark.createDataFrame([("x",)], "t string")).count() == 0


def test_a_wide_keyed_side_is_not_broadcast(spark):
    large = spark.range(1000).select((F.col("id") % 20).cast("string").alias("k"))
    keyed = spark.range(20).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("x"), 3 << 20).alias("wide"))
    assert not joins.small_enough(keyed, 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastExchange" not in plan(joins.keyed_join(large, keyed, ["k"], "inner", 20))
        assert "BroadcastExchange" in plan(joins.keyed_join(large, keyed.select("k"), ["k"], "inner", 20))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins.keyed_join(large, keyed.select("k"), ["k"], "left_semi", 20).count() == 1000


def test_a_cluster_has_to_name_its_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
