"""Order-preserving packing: window cuts chosen by dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framegauge.llm.sequences import Encoded, Piece, encoded_documents, pack, sequence_batches
from framegauge.llm.vocabulary import vocabulary

# Tokens solved together.  The last window of a block is handed on to the next one,
# so that a block's end forces no cut.
BLOCK_TOKENS = 1 << 19
# Bytes of pieces remembered in a generation: blocks and cuts are held beside them.
WINDOW_MEMO_BYTES = 36 << 20


class CutCosts(NamedTuple):
    """What a cut costs, in padding tokens: between documents, between sentences, and
    elsewhere, which is only considered every ``stride`` tokens of a long sentence."""

    document: float = 0.0
    sentence: float = 1.0
    inside: float = 8.0
    stride: int = 64


@lru_cache(maxsize=2)
def sentence_marks(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By token id: ends a sentence if white space follows; starts with white space; ends a line."""
    tokens = vocabulary(tokenizer).token_bytes
    closing = tuple(c.encode() for c in ".!?…。！？")
    return (np.array([t.rstrip(b"\"')]").endswith(closing) for t in tokens]),
            np.array([t[:1].isspace() for t in tokens]), np.array([b"\n" in t for t in tokens]))


def cut_points(ids: np.ndarray, marks: tuple[np.ndarray, np.ndarray, np.ndarray], stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions inside a document where it may be cut, and whether each is a sentence boundary."""
    ends, opens, lines = marks
    sentence = np.flatnonzero(ends[ids[:-1]] & opens[ids[1:]] | lines[ids[:-1]]) + 1
    edges = np.concatenate([[0], sentence, [len(ids)]])
    wide = np.flatnonzero(np.diff(edges) > stride)
    if not len(wide):
        return sentence, np.ones(len(sentence), bool)
    inside = np.concatenate([np.arange(edges[i] + stride, edges[i + 1], stride) for i in wide])
    at = np.concatenate([sentence, inside])
    order = np.argsort(at, kind="stable")
    return at[order], (np.arange(len(at)) < len(sentence))[order]


def best_cuts(positions: np.ndarray, costs: np.ndarray, window: int, more: bool = False) -> list[int]:
    """Indexes into ``positions`` (ascending, from 0 to the block's end) of the cheapest cuts.

    With f(j) the least cost of everything before position j,

        f(j) = cost(j) + min(f(i) + window - (positions[j] - positions[i]))

    over the i at most a window back, that is cost(j) + window - positions[j] +
    min(f(i) + positions[i]): the minimum over a sliding range, which a monotone queue
    keeps at its head.  Of equal choices the longest window wins.

    A short window counts as padded to ``window`` here even where it need not be (a
    power of two): many short sequences are no better than padding.  With ``more`` to
    come behind the end, the last window is not padded and its end is no cut.
    """
    count = len(positions)
    place = positions.tolist()
    cost = costs.tolist()
    best = [0.0] * count
    previous = [0] * count
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, count):
        here = place[j]
        while place[queue[0][1]] < here - window:
            queue.popleft()
        least, i = queue[0]
        best[j], previous[j] = least + window - here + cost[j], i
        key = best[j] + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    cuts = []
    j = count - 1
    if more and j:
        within = range(int(np.searchsorted(positions, place[j] - window)), j)
        previous[j] = min(within, key=lambda i: (best[i], -i))
    while j > 0:
        cuts.append(j)
        j = previous[j]
    return cuts[::-1]


def window_sequences(documents: Iterable[Encoded], tokenizer: str, window: int, costs: CutCosts,
                     block_tokens: int) -> Iterator[list[Piece]]:
    """Sequences of the documents' tokens in their order."""
    marks = sentence_marks(tokenizer)
    stride = min(costs.stride, window)
    block: list[Encoded] = []
    held = 0

    def end_cost(doc: Encoded) -> float:
        """A document's own end is free; a part's end is a place inside the text."""
        if doc.start + len(doc.ids) == doc.total:
            return costs.document
        ends, opens, lines = marks
        sentence = ends[doc.ids[-1]] and opens[doc.after] or lines[doc.ids[-1]]
        return costs.sentence if sentence else costs.inside

    def solve(last: bool) -> Iterator[list[Piece]]:
        nonlocal block, held
        at, cost = [np.zeros(1, np.int64)], [np.zeros(1)]
        start = 0
        for doc in block:
            inner, sentence = cut_points(doc.ids, marks, stride)
            at += [inner + start, [start + len(doc.ids)]]
            cost += [np.where(sentence, costs.sentence, costs.inside), [end_cost(doc)]]
            start += len(doc.ids)
        positions = np.concatenate(at)
        cuts = positions[best_cuts(positions, np.concatenate(cost), window, not last)].tolist()
        if not last and len(cuts) > 1:
            cuts.pop()
        pending = deque(block)
        begin = 0
        for end in cuts:
            need, pieces = end - begin, []
            while need:
                doc = pending.popleft()
                taken = doc.ids[:need]
                pieces.append(Piece(doc.doc_id, doc.start, taken, doc.total))
                if len(taken) < len(doc.ids):
                    pending.appendleft(doc._replace(start=doc.start + need, ids=doc.ids[need:]))
                need -= len(taken)
            begin = end
            yield pieces
        block = list(pending)
        held = sum(len(d.ids) for d in block)

    for doc in documents:
        # A very long document passes through in parts, so that a block stays small.
        for start in range(0, len(doc.ids), block_tokens):
            part = doc.ids[start:start + block_tokens]
            after = int(doc.ids[start + len(part)]) if start + len(part) < len(doc.ids) else -1
            block.append(doc._replace(start=start, ids=part, after=after))
            held += len(part)
            if held >= block_tokens:
                yield from solve(last=False)
    if block:
        yield from solve(last=True)


def window_pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id",
                text: str = "text", costs: CutCosts = CutCosts(), block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents cut into sequences of at most ``window`` tokens, in the order of the rows.

    Returns sequence_id, n_tokens, segments (doc_id, start, length, doc_tokens,
    offset), ids (n_tokens little-endian 32-bit ids) and padded_length (a power of
    two or the window).  A document is its ids and ``end_id``; null and empty texts
    are ``end_id`` alone.  Repeated rows are packed each by itself and null ids are
    passed on.  Every token lies in exactly one piece.  Other columns are ignored.

    A window never joins rows of two input partitions, so there is no shuffle and a
    lost task makes the same sequences again; a task holds one block of tokens.
    """

    def run(batches, kind):
        def row(ids, ends):
            size = len(ids)
            return {"ids": ids.tobytes(), "padded_length": size if size & (size - 1) == 0 else window}

        documents = encoded_documents(batches, tokenizer, end_id, WINDOW_MEMO_BYTES)
        return sequence_batches(window_sequences(documents, tokenizer, window, costs, block_tokens), kind, row,
                                [("ids", pa.binary()), ("padded_length", pa.int32())])

    return pack(docs, doc_id, text, run, "ids binary, padded_length int")
