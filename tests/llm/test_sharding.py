"""The shuffle into shards: exact sizes, exact marginals, and the distribution of a uniform permutation."""

import zlib
from collections import Counter
from itertools import permutations
from math import comb

import numpy as np
import pytest

from framegauge.llm import sharding as sh
from framegauge.llm.queries import op12_sharding

SF = "/root/testdata/sf0.001"


def chi_square(counts, expected):
    return sum((c - e) ** 2 / e for c, e in zip(counts, expected))


@pytest.mark.parametrize("limit", [sh.NUMPY_ROWS, 0])
def test_hypergeometric_weights(monkeypatch, limit):
    monkeypatch.setattr(sh, "NUMPY_ROWS", limit)
    rng = sh.generator(1)
    good, bad, drawn, times = 12, 9, 7, 20_000
    got = Counter(sh.hypergeometric(rng, good, bad, drawn) for _ in range(times))
    expected = [times * comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) for k in range(drawn + 1)]
    # 0.999 quantile of chi-square with 7 degrees of freedom.
    assert chi_square([got[k] for k in range(drawn + 1)], expected) < 24.4
    assert sh.hypergeometric(rng, 0, 5, 3) == 0 and sh.hypergeometric(rng, 5, 0, 3) == 3 and sh.hypergeometric(rng, 5, 5, 10) == 5


def test_huge_populations():
    rng = sh.generator(2)
    good, bad, drawn = 3 * 10**11, 7 * 10**11, 4 * 10**11
    spread = (drawn * 0.3 * 0.7 * 0.6) ** 0.5
    draws = [sh.hypergeometric(rng, good, bad, drawn) for _ in range(30)]
    assert all(abs(d - 12 * 10**10) < 6 * spread for d in draws) and len(set(draws)) > 25
    sizes = np.array([10**10, 0, 5 * 10**9, 10**9])
    assert sh.shares(rng, sizes, int(sizes.sum())).tolist() == sizes.tolist() and sh.shares(rng, sizes, 10**9).sum() == 10**9


def test_matrix_margins():
    sizes = np.array([5, 0, 17, 3, 40, 1, 9])
    before = np.concatenate([[0], np.cumsum(sizes)])
    bins = np.array([20, 20, 20, 15])
    rows = [sh.matrix_row(before, i, bins, 4) for i in range(len(sizes))]
    cells = np.array([own for own, _ in rows])
    assert cells.sum(axis=1).tolist() == sizes.tolist() and cells.sum(axis=0).tolist() == bins.tolist() and cells.min() >= 0
    assert [e.tolist() for _, e in rows] == [cells[:i].sum(axis=0).tolist() for i in range(len(sizes))]


def order_of(sizes, shards, seed):
    """What the tasks do, in one process: the rows in order of shard and slot."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    shard, first, bins = sh.bins_of(sh.shard_sizes(int(before[-1]), shards), 2)
    placed = {}
    for p, n in enumerate(sizes):
        own, earlier = sh.matrix_row(before, p, bins, seed)
        target = np.repeat(np.arange(len(own)), own)
        arrival = np.repeat(earlier - (np.cumsum(own) - own), own) + np.arange(n)
        perm = sh.generator(seed, 2, p).permutation(n)
        for k, (b, a) in enumerate(zip(target[perm], arrival[perm])):
            slot = (first[b] + sh.generator(seed, 3, int(b)).permutation(int(bins[b])))[a]
            placed[int(shard[b]), int(slot)] = int(before[p]) + k
    return tuple(placed[k] for k in sorted(placed))


def test_every_permutation_is_equally_likely():
    times = 4800
    got = Counter(order_of([3, 1], 2, seed) for seed in range(times))
    assert set(got) == set(permutations(range(4)))
    # 0.999 quantile of chi-square with 23 degrees of freedom.
    assert chi_square(got.values(), [times / 24] * 24) < 49.8


def check_shards(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("bin_rows", [7, 1 << 20])
def test_rows_keep_their_columns(spark, bin_rows):
    rows = [(i // 3 if i % 5 else None, None if i % 7 == 0 else "x" * (i % 4) * 1000, -i, i % 2) for i in range(501)]
    df = spark.createDataFrame(rows, "id bigint, text string, slot bigint, `odd.bin` int").repartition(6)
    out = sh.shuffle_into_shards(df, 4, seed=9, bin_rows=bin_rows)
    got = out.collect()
    assert out.columns == ["id", "text", "odd.bin", "shard", "slot"]
    check_shards(got, 4)
    assert Counter(r[:3] for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    assert sorted(map(str, got)) == sorted(map(str, out.collect()))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "id bigint").repartition(3)
    check_shards(sh.shuffle_into_shards(df, 5).collect(), 5)
    assert sh.shuffle_into_shards(df.limit(0), 5).collect() == []


def test_written_shards(spark, tmp_path):
    out = sh.shuffle_into_shards(spark.range(1000).repartition(5), 3, bin_rows=100)
    sh.write_shards(out, str(tmp_path / "shards"), rows_per_file=150)
    assert sorted(p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()) == ["shard=0", "shard=1", "shard=2"]
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r["id"], r["shard"], r["slot"]) for r in read.collect()} == {(r["id"], r["shard"], r["slot"]) for r in out.collect()}


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op12_sharding(spark, SF).collect()
    check_shards(got, 40)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {
        i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in docs.items()}
