from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest

from framegauge.operators import row_groups
from framegauge.plans import table_profile
from framegauge.plans.table_profile import group_scores
from tests.test_plans import plan


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows, inf, nan = [], float("inf"), float("nan")
    for i in range(3000):
        g = None if i % 97 == 0 else f"g{i % 150}" if i % 5 else "large"
        day = None if i % 4 == 0 or g == "g7" else date(2020, 1, 1 + i % 28)
        row = (g, i % 3, 2**60 + int(rng.integers(0, 3)), [0.0, -0.0, 1.5, nan, inf, -inf, 40.0, None][int(rng.integers(0, 8))],
               Decimal(int(rng.integers(0, 40)) ** 3) / 100, ["a", "", None][i % 3], day, None if day is None else datetime(2020, 1, day.day), i % 2 == 0)
        rows += [row] * (1 + i % 3 // 2)
    return spark.createDataFrame(rows, "g string, h int, a bigint, b double, c decimal(30,2), d string, e date, t timestamp, f boolean").repartition(7)


@pytest.mark.parametrize("latest", [None, "e", "t"])
def test_counted_together_as_by_arrays(frame, monkeypatch, latest):
    for keys in (("g",), ("g", "h"), ("t", "c")):
        if latest in keys:
            continue
        found = sorted(map(str, group_scores(frame, *keys, latest=latest).collect()))
        with monkeypatch.context() as m:
            m.setattr(table_profile, "plain_types", lambda df: False)
            assert found == sorted(map(str, group_scores(frame, *keys, latest=latest).collect()))
            m.setattr(table_profile, "ARRAY_ROWS", 10)
            assert found == sorted(map(str, group_scores(frame, *keys, latest=latest).collect()))


def test_groups_over_several_batches(spark, frame):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = sorted(map(str, group_scores(frame, "g", latest="t").collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert found == sorted(map(str, group_scores(frame, "g", latest="t").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_are_shuffled_once(frame):
    text = plan(group_scores(frame.coalesce(1), "g", latest="t"))
    assert text.count("Arguments: hashpartitioning") == 1 and "ObjectHashAggregate" not in text and "Join" not in text


def test_other_types_go_by_arrays(spark):
    df = spark.createDataFrame([("x", 1.0, {"k": 1}), ("x", 1.0, {"k": 1}), ("y", None, None)], "g string, v double, m map<string,int>")
    assert not row_groups.plain_types(df)
    assert sorted(map(tuple, group_scores(df, "g").select("g", "rows", "missing_cells", "duplicate_rows").collect())) == [
        ("x", 2, 0, 1), ("y", 1, 2, 0)]
