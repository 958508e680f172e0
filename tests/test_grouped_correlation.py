import numpy as np
import pandas as pd
import pytest

from framegauge.operators import correlation
from framegauge.operators.correlation import correlation_matrix
from tests.test_plans import plan

COLUMNS = 40


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(3000, COLUMNS)), columns=[f"c{i}" for i in range(COLUMNS)])
    pdf["c1"] = pdf["c0"] * 2 + 1e9
    pdf["c7"] = pdf["c0"] + pdf["c8"] * 0.1
    pdf.loc[::3, "c2"] = np.nan
    pdf["c3"], pdf["c5"] = 0.1, np.nan
    # Two thirds of the rows are one group; some groups have one or two rows, one has no name.
    ids = np.where(np.arange(3000) % 3 < 2, 0, 1 + np.arange(3000) % 200)
    pdf["g"] = [None if i == 7 else f"g{i}" for i in ids]
    pdf["h"] = ids % 2
    pdf.loc[5, "c4"] = np.inf
    return pdf


@pytest.fixture(scope="module")
def frame(spark, pdf):
    return spark.createDataFrame(pdf).repartition(6)


def expected(pdf):
    for (g, h), rows in pdf.groupby(["g", "h"], dropna=False):
        numbers = rows.drop(columns=["g", "h"])
        endless = np.isinf(numbers).any()
        corr = numbers.loc[:, ~endless].corr(min_periods=2).reindex(index=numbers.columns, columns=numbers.columns).fillna(0.0)
        yield (None if pd.isna(g) else g, h), corr


def compare(got, pdf):
    found = {}
    for r in got:
        found.setdefault((r["g"], r["h"]), {})[r["x"], r["y"]] = r["corr"]
    want = dict(expected(pdf))
    assert set(found) == set(want)
    for key, corr in want.items():
        # Two or more values of pairs that are constant within a group have rounding for a deviation in pandas.
        wrong = [(x, y) for x in corr for y in corr if "c3" not in (x, y) and not abs(found[key][x, y] - corr.loc[x, y]) <= 0.0011]
        assert not wrong, (key, wrong[:5], [(found[key][w], corr.loc[w]) for w in wrong[:5]])
        assert all(found[key][x, y] == 0.0 for x, y in found[key] if "c3" in (x, y))


def test_many_columns_by_group_without_an_expand(frame, pdf):
    got = correlation_matrix(frame, ("g", "h"))
    assert "Expand" not in plan(got)
    compare(got.collect(), pdf)


def test_shares_of_hot_groups_combine(monkeypatch, frame, pdf):
    # 25 rows to a share, so that also groups of the middle are cut.
    monkeypatch.setattr(correlation.grouped_matrix_correlations, "__defaults__", (25 * COLUMNS,))
    compare(correlation_matrix(frame, ("g", "h")).collect(), pdf)


def test_same_as_few_columns(frame):
    few = correlation_matrix(frame.select("g", "h", *[f"c{i}" for i in range(9)]), ("g", "h")).collect()
    many = {(r["g"], r["h"], r["x"], r["y"]): r["corr"] for r in correlation_matrix(frame, ("g", "h")).collect()}
    # With few columns, 0.1 throughout can have a deviation by rounding, here it has none.
    assert all(abs(many[r["g"], r["h"], r["x"], r["y"]] - r["corr"]) < 0.0011 for r in few if (r["x"], r["y"]) != ("c3", "c3"))


def test_no_rows(spark, frame):
    assert correlation_matrix(frame.where("h > 5"), ("g", "h")).count() == 0


def test_hot_groups_are_summed_up_where_they_are_read(spark, monkeypatch):
    rng = np.random.default_rng(5)
    hot = pd.DataFrame(rng.normal(size=(12_000, COLUMNS)) + 1e6, columns=[f"c{i}" for i in range(COLUMNS)])
    hot["c1"], hot["c3"] = hot["c0"] * 3, 0.1
    hot.loc[::5, "c2"] = np.nan
    hot.loc[9, "c4"] = np.inf
    hot["g"] = [(None, "a", "b")[i % 3] for i in range(len(hot))]
    cold = pd.DataFrame(rng.normal(size=(90, COLUMNS)), columns=hot.columns[:COLUMNS])
    cold["c3"], cold["g"] = 0.1, [f"z{i % 30}" for i in range(90)]
    met = []
    shared = correlation._shared_moments
    monkeypatch.setattr(correlation, "_shared_moments", lambda placed, *more: (met.append(placed.count()), shared(placed, *more))[1])
    # Two groups to a task's memory, so that moments are handed on in between.
    monkeypatch.setattr(correlation._read_moments, "__defaults__", (2 * correlation.MOMENT_BYTES * COLUMNS * (COLUMNS + 1) // 2,))
    for pdf, left in ((hot, []), (pd.concat([hot, cold], ignore_index=True), [90])):
        pdf["h"] = 1
        met.clear()
        got = correlation_matrix(spark.createDataFrame(pdf).repartition(4), ("g", "h")).collect()
        assert met == left
        compare(got, pdf)
