"""Both packers: cuts and bins by definition, and no token lost."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegauge.llm import sequences, window_packing
from framegauge.llm.queries import TOKENIZER
from framegauge.llm.sequences import Encoded, pieces_of
from framegauge.llm.token_matrix import best_fit_decreasing, token_matrix, write_matrix
from framegauge.llm.vocabulary import MEMO_BYTES, library_encoder
from framegauge.llm.window_packing import CutCosts, best_cuts, window_pack, window_sequences


def cost_of(cuts, positions, costs, window):
    edges = [0, *cuts]
    assert all(0 < positions[j] - positions[i] <= window for i, j in zip(edges, edges[1:]))
    return sum(costs[j] + window - (positions[j] - positions[i]) for i, j in zip(edges, edges[1:]))


def test_cuts_cost_no_more_than_any_others():
    choice = random.Random(2)
    for _ in range(300):
        window = choice.randint(3, 20)
        steps = [choice.randint(1, min(6, window)) for _ in range(choice.randint(1, 25))]
        positions = np.concatenate([[0], np.cumsum(steps)])
        costs = np.array([choice.choice([0.0, 1.0, 5.0, 8.0]) for _ in positions])
        best = [0.0] * len(positions)
        for j in range(1, len(positions)):
            best[j] = min(best[i] + costs[j] + window - (positions[j] - positions[i])
                          for i in range(j) if positions[j] - positions[i] <= window)
        cuts = best_cuts(positions, costs, window)
        assert cuts[-1] == len(positions) - 1
        assert abs(cost_of(cuts, positions, costs, window) - best[-1]) < 1e-9


def plain_best_fit(lengths, window):
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b in bins if b[0] >= lengths[i]]
        if fits:
            best = min(fits, key=lambda b: b[0])
        else:
            bins.append(best := [window, []])
        best[0] -= lengths[i]
        best[1].append(i)
    return bins


def test_bins_are_as_full_as_best_fit_makes_them():
    choice = random.Random(3)
    for _ in range(200):
        window = choice.choice([1, 2, 7, 8, 9, 31, 64])
        lengths = [choice.randint(1, window) for _ in range(choice.randint(0, 60))]
        bins = best_fit_decreasing(lengths, window)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        got = sorted(sum(lengths[i] for i in b) for b in bins)
        assert got == sorted(window - b[0] for b in plain_best_fit(lengths, window))


def test_blocks_force_no_cut():
    documents = [Encoded(i, 0, np.full(n, 5, "<u4"), n) for i, n in enumerate([3, 9, 40, 1, 1, 17, 30, 2] * 20)]
    costs = CutCosts(stride=4)
    short = list(window_sequences(iter(documents), TOKENIZER, 16, costs, 50))
    assert sum(len(p.ids) for s in short for p in s) == sum(len(d.ids) for d in documents)
    assert all(sum(len(p.ids) for p in s) <= 16 for s in short)
    sizes = [sum(len(p.ids) for p in s) for s in short]
    assert sum(16 - n for n in sizes[:-1]) / (16 * len(sizes)) < 0.2
    order = [(p.doc_id, p.start) for s in short for p in s]
    assert order == sorted(order)


ROWS = [(1, "One sentence. Another one! " * 30), (2, None), (3, ""), (3, ""), (None, "no id."), (5, "x" * 9000),
        (6, "word " * 5000), (7, "A line\nand another\n" * 400), (1, "One sentence. Another one! " * 30)]


@pytest.mark.parametrize("pack, end", [(window_pack, 1), (token_matrix, 50256)])
@pytest.mark.parametrize("window", [64, 2048])
def test_every_token_once(spark, pack, end, window):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id bigint, text string, ids string").repartition(3)
    rows = pack(docs, TOKENIZER, window=window, end_id=end).collect()
    encode = library_encoder(TOKENIZER)
    ids_of = {(i, t): np.frombuffer(b"".join(encode(t)) + end.to_bytes(4, "little"), "<u4") for i, t in ROWS}
    left = sorted((str(i), len(v)) for (i, t), v in [((i, t), ids_of[i, t]) for i, t in ROWS])
    found = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        at = 0
        for s in r["segments"]:
            assert s["offset"] == at and s["length"] > 0
            found.setdefault((s["doc_id"], s["doc_tokens"]), []).append((s["start"], tuple(ids[at:at + s["length"]])))
            at += s["length"]
        assert at == r["n_tokens"] <= window
    for (i, total), pieces in found.items():
        whole = next(v for (k, t), v in ids_of.items() if k == i and len(v) == total)
        assert {(s, p) for s, p in pieces} == {(s, tuple(whole[s:s + len(p)])) for s, p in pieces}
        copies = left.count((str(i), total))
        assert sum(len(p) for _, p in pieces) == copies * total
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert pack(docs.limit(0), TOKENIZER).count() == 0


def test_matrix_columns(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    write_matrix(token_matrix(docs, TOKENIZER, window=128), str(tmp_path / "m"))
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, positions = (np.frombuffer(r[c], "<u4") for c in ("ids", "positions"))
        edges = r["cu_seqlens"]
        assert len(ids) == len(positions) == 128 and edges[0] == 0 and edges[-1] == 128
        assert edges[1:len(r["segments"]) + 1] == [s["offset"] + s["length"] for s in r["segments"]]
        assert positions.tolist() == [i - a for a, b in zip(edges, edges[1:]) for i in range(a, b)]
        assert (ids[r["n_tokens"]:] == 50256).all()


@pytest.mark.parametrize("pack, name", [(window_pack, "padded_length"), (token_matrix, "positions")])
def test_digests_come_from_the_packed_ids(spark, pack, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = pack(docs, TOKENIZER)
    pieces = pieces_of(packed, "ids", (name, lambda s: F.col(name))).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    encode, end = library_encoder(TOKENIZER), 1 if pack is window_pack else 50256
    for doc_id, group in pieces.groupby("doc_id"):
        ids = b"".join(encode(texts[doc_id])) + end.to_bytes(4, "little")
        group = group.sort_values("start")
        assert group["start"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]
        for p in group.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[4 * p.start:4 * (p.start + p.length)]) and p.doc_tokens == len(ids) // 4
    sizes = pieces.groupby("sequence_id")["length"].sum()
    assert (2048 - sizes).sum() < 0.05 * sizes.sum() + 2048 * packed.rdd.getNumPartitions()


def test_parts_of_a_long_document_are_no_free_cuts():
    ids = np.array([ord(c) % 200 + 300 for c in "abcdefghij" * 500], dtype="<u4")
    docs = [Encoded(1, 0, ids, len(ids)), Encoded(2, 0, ids[:100], 100)]
    whole, parts = ([[len(p.ids) for p in s] for s in window_sequences(docs, TOKENIZER, 256, CutCosts(), block)] for block in (1 << 19, 700))
    assert sum(map(sum, whole)) == sum(map(sum, parts)) == 5100
    assert len(parts) <= len(whole) + 1 and sum(sum(s) < 250 for s in parts) <= sum(sum(s) < 250 for s in whole) + 1


def test_window_packing_remembers_less(monkeypatch):
    asked = []
    monkeypatch.setattr(sequences, "library_encoder", lambda path, memo_bytes: asked.append(memo_bytes) or library_encoder(path, memo_bytes))
    docs = window_packing.encoded_documents([], TOKENIZER, 1, window_packing.WINDOW_MEMO_BYTES)
    assert list(docs) == [] and asked == [window_packing.WINDOW_MEMO_BYTES] and asked[0] < MEMO_BYTES
    small = library_encoder(TOKENIZER, 4096)
    assert [small(f"word{i} other{i}") for i in range(300)] == [library_encoder(TOKENIZER)(f"word{i} other{i}") for i in range(300)]
    assert (small.spaced.limit, small.plain.limit) == (4096, 1024) and small.spaced.size <= 4096 and small.plain.size <= 1024
