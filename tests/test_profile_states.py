"""States of parts against the state and the profile of the whole; duplicates by digests."""

import random
from collections import Counter
from datetime import datetime

import pytest

from framegauge.operators import column_profile as cp
from framegauge.operators import profile_states as ps
from framegauge.operators.correlation import correlation_matrix
from framegauge.operators.duplicates import duplicate_rows

SCHEMA = "g string, i bigint, `f.x` double, s string, b boolean, t timestamp, a array<int>, part int"


def rows(n=400):
    choice = random.Random(2)
    return [(choice.choice(["x", "y", None]), choice.choice([None, 10**6 + i % 50]), choice.choice([float("nan"), None, 1e8 + choice.random(), 0.0, -0.0]),
             choice.choice([None, "", "same", f"s{i}"]), choice.choice([True, False, None]), datetime(2024, 1, 1 + i % 9), [i % 3] if i % 4 else None,
             choice.choice([0, 0, 0, 1, 2])) for i in range(n)]


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-9, abs=1e-9))


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_merged_parts_equal_the_whole(spark, tmp_path, keys):
    df = spark.createDataFrame(rows(), SCHEMA)
    whole, columns = df.drop("part"), str(tmp_path / "columns")
    for p in range(4):
        part = df.where(f"part = {p}").drop("part")
        ps.column_states(part, keys).write.mode("append").parquet(columns)
        ps.pair_states(part, keys).write.mode("append").parquet(str(tmp_path / "pairs"))
    merged = ps.profile_of_states(ps.merge_column_states(spark.read.parquet(columns), keys), keys)
    direct = {tuple(r[k] for k in (*keys, "column")): r for r in ps.profile_of_states(ps.column_states(whole, keys), keys).collect()}
    exact = {tuple(r[k] for k in (*keys, "column")): r["unique"] for r in cp.column_unique(whole, keys).collect()}
    got = {tuple(r[k] for k in (*keys, "column")): r for r in merged.collect()}
    assert set(got) == set(direct)
    for k, r in got.items():
        assert all(near(r[c], direct[k][c]) for c in merged.columns), (k, r, direct[k])
        assert r["unique"] is None if k[-1] == "a" else abs(r["unique"] - exact.get(k, 0)) <= 1 + 4 * ps.unique_error() * exact.get(k, 0)
    if not keys:
        counts = {r["column"]: r for r in cp.column_counts(whole).collect()}
        for (c,), r in got.items():
            moments = ("mean", "std", "min", "max") if c in ("i", "f.x") else ()
            assert all(near(r[m], counts[c][m]) for m in ("rows", "missing", "count", *moments)), c
        pairs = ps.correlations_of_states(ps.merge_pair_states(spark.read.parquet(str(tmp_path / "pairs"))))
        assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in correlation_matrix(whole).select("x", "y", "corr").collect()}


def test_states_of_nothing_and_of_constants(spark):
    none = spark.createDataFrame([], "i bigint, s string")
    got = {r["column"]: r for r in ps.profile_of_states(ps.merge_column_states(ps.column_states(none))).collect()}
    assert {(r["rows"], r["missing"], r["missing_percent"], r["unique"], r["mean"]) for r in got.values()} == {(0, 0, 0.0, 0, None)}
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "c double, d double")
    assert {tuple(r) for r in ps.correlations_of_states(ps.merge_pair_states(ps.pair_states(same))).collect()} == {
        ("c", "c", 0.0), ("c", "d", 0.0), ("d", "c", 0.0), ("d", "d", 1.0)}
    with pytest.raises(ValueError):
        ps.pair_states(none.select("s"))


def test_missing_values_by_key(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {r["g"]: {c: v["count"] for c, v in r["missing_values"].items()} for r in cp.missing_values(df, ("g",)).collect()}
    want = {}
    for r in cp.column_missing(df, ("g",)).collect():
        want.setdefault(r["g"], {})[r["column"]] = r["missing"]
    assert got == want


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_duplicates_by_digests(spark, monkeypatch, broadcast):
    from framegauge.operators import joins
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    data = rows(150) + rows(60) + [(None, None, None, "a", None, None, None, 0), (None, None, None, None, None, None, None, 0)] * 3
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    whole = Counter(tuple(None if v != v else v + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in data)
    assert duplicate_rows(df).first()[0] == sum(n - 1 for n in whole.values())
    assert duplicate_rows(df.limit(0)).first()[0] == 0
    shifted = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert duplicate_rows(shifted).first()[0] == 0 and duplicate_rows(shifted.unionByName(shifted)).first()[0] == 2
    maps = spark.createDataFrame([({"a": 1},), ({"a": 1},)], "m map<string,int>")
    assert duplicate_rows(maps).first()[0] == 1
