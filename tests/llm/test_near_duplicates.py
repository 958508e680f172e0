"""Components, SimHash and the metric join against brute force."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from framegauge.llm import simhash_dedup as sim
from framegauge.llm.components import connected_components
from framegauge.llm.metric_join import assign_cells, metric_range_join


def reachable(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    choice = random.Random(1)
    edges = [(choice.randint(0, 400), choice.randint(0, 400)) for _ in range(230)]
    edges += [(500 + i, 501 + i) for i in range(70)] + [(900, 1000 + i) for i in range(300)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == reachable([e for e in edges if e[0] != e[1]], linked)
    assert connected_components(df.limit(0), "a", "b").count() == 0


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \n\t ", "one", "One two", "a b c", "A B\tC", "a a a a a a", "É é ÉÉ   x   y z", "w " * 70_000,
         "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy cat"]


def test_fingerprints():
    assert [sim.fingerprint(t) for t in TEXTS] == [plain_fingerprint(t) for t in TEXTS]


def test_groups_of_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] * 2 + [(None, "a b c"), (None, "nothing else like it here")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, fp int")
    got = sim.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    near = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    want = reachable(near, prints)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    assert {r["fingerprint"] for r in got if r["doc_id"] == 1} == {"0" * 16}
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [want[5], None]
    assert sim.simhash_groups(docs.limit(0)).count() == 0


def test_pairs_of_a_list_are_told_apart_by_their_tally():
    assert sim.differing_bytes(np.array([0, 1, 0x80, 0x8000, 0x0101, 1 << 63, (1 << 64) - 1], np.uint64)).tolist() == [0, 1, 1, 1, 2, 1, 8]
    # One bit in each of three bytes: too few shared bytes; two bits in one byte; three there.
    values = np.array([0, 0x010101, 0x03, 0x07 << 8], np.uint64)
    assert sim.list_edges(values, 2) == [(2, 0)]


def test_linked_fingerprints_share_a_list():
    choice = random.Random(5)
    order = np.array(choice.sample(range(2048), 2048)).reshape(8, 256)
    one = np.array([choice.getrandbits(64) for _ in range(2000)], np.uint64)
    other = one ^ np.array([sum(1 << b for b in choice.sample(range(64), choice.randint(1, 2))) for _ in one], np.uint64)
    (m, k), (n, l) = (sim.prefix_lists(v, order, 2) for v in (one, other))
    assert m.shape == (2000, 15)
    assert all(set(zip(*a)) & set(zip(*b)) for a, b in zip(zip(m.tolist(), k.tolist()), zip(n.tolist(), l.tolist())))


@pytest.mark.parametrize("max_bits, list_rows", [(1, 2048), (2, 2048), (2, 3), (1, 1), (0, 2048)])
def test_edges_connect_what_is_linked(spark, max_bits, list_rows):
    choice = random.Random(max_bits)
    values = {choice.getrandbits(64) for _ in range(300)}
    for v in list(values)[:60]:
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in choice.sample(range(64), choice.randint(1, 3))))
    # One long list: many values that differ in two bytes only.
    base = choice.getrandbits(64)
    values |= {base & ~0xFFFF | low for low in choice.sample(range(65536), 1200)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp bigint, rep bigint")
    edges = [(r["a"], r["b"]) for r in sim.near_edges(df, max_bits, list_rows).collect()]
    matrix = np.array(values, np.uint64)
    near = [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(matrix ^ matrix[i]) <= max_bits)]
    assert all((values[a] ^ values[b]).bit_count() <= 2 * 16 for a, b in edges)
    assert reachable(edges, range(len(values))) == reachable(near, range(len(values)))
    assert len(edges) < 40 * len(values)


def test_replicas_reach_every_close_pair():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(400, 6))
    points[200:] = points[:200] + rng.normal(scale=0.05, size=(200, 6))
    points /= np.linalg.norm(points, axis=1)[:, None]
    angle = np.arccos(np.clip(points @ points.T, -1, 1))
    radius = 0.15
    cells = {}
    for rows, cell, home in assign_cells(angle[:, :9], radius):
        for i in rows:
            cells.setdefault(cell, {})[int(i)] = home
    met = {}
    for members in cells.values():
        for i in members:
            for j in members:
                if i < j and (members[i] or members[j]):
                    met[i, j] = met.get((i, j), 0) + 1
    close = [(i, j) for i in range(400) for j in range(i + 1, 400) if angle[i, j] <= radius]
    assert close and all(met.get(p) == 1 for p in close)


@pytest.mark.parametrize("cell_rows, block_rows", [(4096, 2048), (60, 40), (25, 10)])
def test_metric_join(spark, cell_rows, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    rows = []
    for i in range(260):
        rows.append((i, (centres[i % 30] + rng.normal(scale=0.08, size=8)).astype(np.float32).tolist(), int(i % 7 == 0)))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [math.nan] * 8, 1), (2003, [math.inf] + [0.0] * 7, 1), (2004, [], 1),
             (2005, rows[0][1], None), (2006, [1.0, None] + [0.0] * 6, 1), (2007, rows[0][1][:5], 1), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<float>, label int, n_links int").repartition(6)
    got = sorted(map(tuple, metric_range_join(df, cell_rows=cell_rows, block_rows=block_rows).collect()))

    def good(v):
        return v is not None and len(v) == 8 and None not in v and all(map(math.isfinite, v)) and any(v)

    unit = {k: np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for k, r in enumerate(rows) if good(r[1]) and r[2] is not None}
    links = {k: [m for m in unit if m != k and rows[m][2] == rows[k][2] and unit[k] @ unit[m] >= 0.98] for k in unit}
    whole = reachable([(rows[k][0], rows[m][0]) for k in links for m in links[k]], {r[0] for r in rows})
    want = sorted((r[0], len(links.get(k, ())), whole[r[0]], whole[r[0]] == r[0]) for k, r in enumerate(rows))
    assert got == want
    assert metric_range_join(df.limit(0)).count() == 0
