"""Quartiles and outliers against brute force, through every path."""

import numpy as np
import pandas as pd
import pytest

from framegauge.operators import column_profile as cp
from framegauge.operators import joins


def brute_force(pdf, columns):
    rows = []
    for c in columns:
        v = pdf[c].dropna().to_numpy(dtype=float)
        if len(v) == 0:
            continue
        q1, q2, q3 = np.percentile(v, [25, 50, 75])
        spread = q3 - q1
        out = int(((v < q1 - 1.5 * spread) | (v > q3 + 1.5 * spread)).sum())
        rows.append((c, q1, q2, q3, out, len(np.unique(v))))
    return pd.DataFrame(rows, columns=["column", "q25", "q50", "q75", "outliers", "unique"])


def assert_same(got, want, on):
    merged = got.merge(want, on=on, suffixes=("", "_want"))
    assert len(got) == len(want) == len(merged)
    for c in ("q25", "q50", "q75", "outliers", "unique"):
        assert (merged[c].astype(float) == merged[f"{c}_want"].astype(float)).all(), merged[[*on, c, f"{c}_want"]]


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    n = 4000
    return pd.DataFrame({
        "g": np.where(np.arange(n) < n // 3, "hot", np.char.add("k", (np.arange(n) % 40).astype(str))),
        "normal": rng.normal(0, 1, n), "heavy_tail": np.exp(rng.normal(0, 6, n)),
        "ties": rng.integers(0, 4, n).astype(float), "far": 1e15 + rng.integers(0, 1000, n),
        "gap": np.where(np.arange(n) % 2, 1e-9 * rng.random(n), 1e9 + rng.random(n)),
        "whole": rng.integers(-10**9, 10**9, n), "constant": np.full(n, 2.5),
        "signed": rng.normal(0, 1, n) * 10.0 ** rng.integers(-300, 300, n),
    })


@pytest.mark.parametrize("task_rows", [100_000, 300, 5])
def test_table(spark, numbers, task_rows):
    pdf = numbers.drop(columns="g")
    got = cp.order_profile(spark.createDataFrame(pdf), task_rows=task_rows).toPandas()
    assert_same(got, brute_force(pdf, pdf.columns), ["column"])


@pytest.mark.parametrize("task_rows, salted", [(100_000, False), (500, False), (20, False), (500, True)])
def test_groups_with_a_hot_one(spark, numbers, monkeypatch, task_rows, salted):
    if salted:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    pdf = numbers[["g", "normal", "heavy_tail", "ties", "whole"]]
    want = pd.concat([brute_force(p, pdf.columns[1:]).assign(g=g) for g, p in pdf.groupby("g")])
    got = cp.order_profile(spark.createDataFrame(pdf), ("g",), task_rows=task_rows).toPandas()
    assert_same(got, want, ["g", "column"])


def test_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))], "v double")
    row = cp.order_profile(df, task_rows=1).first()
    assert (row["q25"], row["q50"], row["q75"], row["outliers"]) == (1.0, 2.0, 3.0, 2)


def test_every_small_size(spark):
    for n in range(1, 10):
        pdf = pd.DataFrame({"v": (np.arange(n) * 37 % 11).astype(float)})
        got = cp.order_profile(spark.createDataFrame(pdf), task_rows=1).toPandas()
        assert_same(got, brute_force(pdf, ["v"]), ["column"])


def test_large_group_with_missing_key(spark):
    pdf = pd.DataFrame({"g": [None] * 50 + ["a"] * 5, "v": [float(i * i) for i in range(55)]})
    got = cp.order_profile(spark.createDataFrame(pdf, "g string, v double"), ("g",), task_rows=10).collect()
    found = {r["g"]: r for r in got}
    assert found[None]["q50"] == np.percentile(pdf["v"][:50], 50) and found["a"]["q50"] == 52.0 ** 2
