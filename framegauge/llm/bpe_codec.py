"""Byte-pair encoding by a segment tree over pair ranks, and decoding."""

from __future__ import annotations

from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framegauge.llm.arrow import held, with_computed
from framegauge.llm.vocabulary import PieceMap, vocabulary

NO_MERGE = 1 << 62
# Children of a node of the segment tree: their minimum is one call, and most words
# have no more pairs than that.
FAN = 16


def merge_by_tree(symbols: list[int], merges: dict[int, int], shift: int) -> list[int]:
    """Ids left when the leftmost pair of lowest rank has been merged until none can be.

    Leaf i of the tree holds the rank, result and position of the pair that starts at
    symbol i; every node the least of its children, so the root is the next merge.  A
    merge changes at most three leaves and the nodes above them.
    """
    end = len(symbols)
    if end < 2:
        return symbols
    find = merges.get
    bits = end.bit_length()
    mask, id_mask = (1 << bits) - 1, (1 << shift) - 1
    leaves = [NO_MERGE] * end
    left_id = symbols[0]
    for i in range(1, end):
        merge = find(left_id << shift | symbols[i])
        if merge is not None:
            leaves[i - 1] = merge << bits | i - 1
        left_id = symbols[i]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k:k + FAN]) for k in range(0, len(below), FAN)])
    top = levels[-1]
    after = list(range(1, end + 1))
    before = list(range(-1, end - 1))
    root = min(top)
    while root != NO_MERGE:
        i = root & mask
        j = after[i]
        made = symbols[i] = root >> bits & id_mask
        symbols[j] = -1
        leaves[j] = leaves[i] = NO_MERGE
        k = after[i] = after[j]
        if k < end:
            before[k] = i
            merge = find(made << shift | symbols[k])
            if merge is not None:
                leaves[i] = merge << bits | i
        h = before[i]
        if h >= 0:
            merge = find(symbols[h] << shift | made)
            leaves[h] = NO_MERGE if merge is None else merge << bits | h
        if top is not leaves:
            changed = {i, j, h} if h >= 0 else {i, j}
            for below, level in zip(levels, levels[1:]):
                changed = {c // FAN for c in changed}
                for c in changed:
                    level[c] = min(below[c * FAN:(c + 1) * FAN])
        root = min(top)
    return [s for s in symbols if s >= 0]


def piece_encoder(path: str) -> PieceMap:
    """Ids of pieces as little-endian 32-bit numbers; one copy per worker process, while it encodes."""
    return held(("encoder", path), lambda: _piece_encoder(path))


def _piece_encoder(path: str) -> PieceMap:
    words = vocabulary(path)
    merges, shift, symbols = words.merges, words.shift, words.symbols

    def as_bytes(word: str) -> bytes:
        ids = merge_by_tree(symbols(word), merges, shift)
        return pack(f"<{len(ids)}I", *ids)

    return PieceMap(words.split, as_bytes, b"".join, {name: pack("<I", i) for name, i in words.special.items()})


def encoded(texts: pa.Array, tokenizer: str) -> pa.ListArray:
    """The id arrays of texts."""
    encoder = piece_encoder(tokenizer)
    parts = [b"".join(encoder(value)) for value in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def decoded(arrays: pa.Array, tokenizer: str) -> pa.Array:
    """The texts of id arrays."""
    known = vocabulary(tokenizer).token_bytes
    values = arrays.flatten()
    flat, ends = values.to_pylist() if values.null_count else values.to_numpy().tolist(), 0
    texts = []
    for length in pc.fill_null(pc.list_value_length(arrays), 0).to_pylist():
        some, ends = flat[ends:ends + length], ends + length
        try:
            data = b"".join(map(known.__getitem__, some))
        except (IndexError, TypeError):
            data = b"".join(known[i] for i in some if i is not None and 0 <= i < len(known))
        texts.append(data.decode("utf-8", "replace"))
    return pa.array(texts, pa.string())


def _ids(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False), False)


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array; null and empty texts have none.

    No begin, end or padding ids.  Added-token strings in a text become their id, as
    the library does by default.  Other columns are passed through.  Rows are
    independent, repeated ones too; a text of any length is encoded whole, in memory of
    a few times its size.  An empty table stays empty.
    """
    return with_computed(docs, text, [_ids(into)], lambda texts: [encoded(texts, tokenizer)])


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``df`` with the text of an id array; added tokens are written out.

    Bytes that are no UTF-8 become U+FFFD and ids that are not in the vocabulary are
    skipped, both as in the library.  A null array gives an empty text, arrays of any
    length are decoded whole.
    """
    return with_computed(df, ids, [T.StructField(into, T.StringType(), False)], lambda arrays: [decoded(arrays, tokenizer)])


def bpe_roundtrip(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with ``bpe_encode``'s ids and the text that ``bpe_decode`` makes of them, in
    place of ``text``: both at once, in one worker."""

    def convert(texts: pa.Array) -> list[pa.Array]:
        arrays = encoded(texts, tokenizer)
        return [arrays, decoded(arrays, tokenizer)]

    return with_computed(docs, text, [_ids(ids), T.StructField(into, T.StringType(), False)], convert, keep_source=False)
