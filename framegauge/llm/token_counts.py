"""Token counts by heap-ordered byte-pair merging; no ids are made."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framegauge.llm.arrow import held, with_computed
from framegauge.llm.vocabulary import PieceMap, vocabulary

def count_after_merges(symbols: list[int], merges: dict[int, int], shift: int) -> int:
    """Symbols left when the adjacent pair of lowest rank has been merged as often as possible.

    The symbols form a linked list.  The heap holds rank, result and the position of
    the left symbol; an entry whose pair has changed meanwhile is skipped.
    """
    end = len(symbols)
    if end < 2:
        return end
    find = merges.get
    bits = end.bit_length()
    mask, id_mask = (1 << bits) - 1, (1 << shift) - 1
    heap = []
    left_id = symbols[0]
    for i in range(1, end):
        merge = find(left_id << shift | symbols[i])
        if merge is not None:
            heap.append(merge << bits | i - 1)
        left_id = symbols[i]
    if not heap:
        return end
    heapify(heap)
    after = list(range(1, end + 1))
    before = list(range(-1, end - 1))
    left = end
    while heap:
        entry = heappop(heap)
        i = entry & mask
        j = after[i]
        if j >= end or symbols[i] < 0:
            continue
        merge = entry >> bits
        if find(symbols[i] << shift | symbols[j]) != merge:
            continue
        made = symbols[i] = merge & id_mask
        symbols[j] = -1
        left -= 1
        k = after[i] = after[j]
        if k < end:
            before[k] = i
            merge = find(made << shift | symbols[k])
            if merge is not None:
                heappush(heap, merge << bits | i)
        h = before[i]
        if h >= 0:
            merge = find(symbols[h] << shift | made)
            if merge is not None:
                heappush(heap, merge << bits | h)
    return left


def piece_counter(path: str) -> PieceMap:
    """One copy per worker process, while it counts."""
    return held(("counter", path), lambda: _piece_counter(path))


def _piece_counter(path: str) -> PieceMap:
    words = vocabulary(path)
    merges, shift, symbols = words.merges, words.shift, words.symbols
    return PieceMap(words.split, lambda word: count_after_merges(symbols(word), merges, shift), sum,
                    dict.fromkeys(words.special, 1))


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in the column ``into``.

    Null and empty texts have 0.  Added-token strings inside a text count as one
    token, as the library counts them by default.  All other columns are passed
    through, whatever their names; a column called ``into`` is replaced, and ``text`` is
    left out without ``keep_text``.  Rows are
    independent: there is no shuffle, and a lost task is simply run again.
    """
    def count(texts: pa.Array) -> list[pa.Array]:
        counter = piece_counter(tokenizer)
        return [pa.array([sum(counter(t)) for t in texts.to_pylist()], pa.int64())]

    return with_computed(docs, text, [T.StructField(into, T.LongType(), False)], count, keep_text)
