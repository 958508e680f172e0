"""Best-fit-decreasing packing into id matrices with segment lengths and positions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framegauge.llm.sequences import Encoded, Piece, encoded_documents, pack, sequence_batches

# Tokens and pieces fitted together by one task.
BLOCK_TOKENS = 1 << 22
BLOCK_PIECES = 1 << 16


class CapacityTree:
    """Segment tree over remaining capacities 0..window: finds the fullest open bin that still fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        node = self.leaves + capacity
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, bin) with the least capacity of at least ``length``; the bin is removed."""
        node = self.leaves + length
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.open[node]:
                    node += 1
        capacity = node - self.leaves
        while node:
            self.open[node] -= 1
            node >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Bins of indexes into ``lengths`` (each at most ``window``), longest first."""
    tree = CapacityTree(window)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = window, len(bins)
            bins.append([])
        capacity, number = found
        bins[number].append(i)
        if capacity > lengths[i]:
            tree.put(capacity - lengths[i], number)
    return bins


def matrix_sequences(documents: Iterable[Encoded], window: int, block_tokens: int) -> Iterator[list[Piece]]:
    """Full windows of overlong documents as they come; the rest fitted block by block."""
    block: list[Piece] = []
    held = 0

    def fitted():
        for chosen in best_fit_decreasing([len(p.ids) for p in block], window):
            yield [block[i] for i in chosen]

    for doc in documents:
        for start in range(0, len(doc.ids), window):
            piece = Piece(doc.doc_id, start, doc.ids[start:start + window], doc.total)
            if len(piece.ids) == window:
                yield [piece]
            else:
                # A copy, or the short end would keep the whole document in memory.
                block.append(piece._replace(ids=piece.ids.copy()))
                held += len(piece.ids)
        if held >= block_tokens or len(block) >= BLOCK_PIECES:
            yield from fitted()
            block, held = [], 0
    yield from fitted()


def token_matrix(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 50256, pad_id: int = 50256,
                 doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of a packed id matrix with all that attention within documents needs.

    Returns sequence_id, n_tokens, segments (doc_id, start, length, doc_tokens,
    offset), ids and positions (``window`` little-endian 32-bit numbers each) and
    cu_seqlens (0, the ends of the pieces, and ``window`` if there is padding).
    Positions count from 0 in every piece and in the padding.  A document is its ids
    and ``end_id``; null and empty texts are ``end_id`` alone.  Overlong documents are
    split at every ``window`` tokens, nothing is cut off.  Repeated rows are packed
    each by itself, null ids are passed on, other columns are ignored.

    Pieces are fitted within blocks of one input partition: no shuffle, a bounded
    block in memory, and the same rows again after a lost task.
    """

    def run(batches, kind):
        def row(ids, ends):
            edges = [0, *ends] if ends[-1] == window else [0, *ends, window]
            positions = np.arange(window, dtype="<u4")
            positions -= np.repeat(np.array(edges[:-1], dtype="<u4"), np.diff(edges))
            matrix = np.full(window, pad_id, dtype="<u4")
            matrix[:len(ids)] = ids
            return {"ids": matrix.tobytes(), "positions": positions.tobytes(), "cu_seqlens": edges}

        documents = encoded_documents(batches, tokenizer, end_id)
        return sequence_batches(matrix_sequences(documents, window, block_tokens), kind, row,
                                [("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(pa.int32()))])

    return pack(docs, doc_id, text, run, "ids binary, positions binary, cu_seqlens array<int>")


def write_matrix(sequences: DataFrame, path: str) -> None:
    """Write the rows as Parquet: fixed-width binary columns that a loader maps to int32 matrices."""
    sequences.write.option("parquet.enable.dictionary", "false").parquet(path)
