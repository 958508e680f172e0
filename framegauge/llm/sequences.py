"""What both packers share: encoded documents in, fixed-length sequences out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framegauge.llm.arrow import row_slices, tidied
from framegauge.llm.vocabulary import MEMO_BYTES, library_encoder

# Sequences of one task are numbered from its partition's number times this.
SEQUENCES_PER_TASK = 1 << 40
# Sequences handed to Spark at a time.
BATCH_SEQUENCES = 512


class Encoded(NamedTuple):
    """Ids of a document from its token ``start`` on; ``total`` counts all of it, ``after``
    is the id that follows a part."""

    doc_id: object
    start: int
    ids: np.ndarray
    total: int
    after: int = -1


class Piece(NamedTuple):
    """Ids of one document that stand together in one sequence."""

    doc_id: object
    start: int
    ids: np.ndarray
    total: int


def encoded_documents(batches: Iterable[pa.RecordBatch], tokenizer: str, end_id: int,
                      memo_bytes: int = MEMO_BYTES) -> Iterator[Encoded]:
    """Documents of (id, text) batches with their ids and ``end_id`` behind them."""
    encode = library_encoder(tokenizer, memo_bytes)
    end = int(end_id).to_bytes(4, "little")
    for batch in batches:
        for rows in row_slices(batch):
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids = np.frombuffer(b"".join(encode(text)) + end, dtype="<u4")
                yield Encoded(doc_id, 0, ids, len(ids))


def sequence_batches(sequences: Iterable[list[Piece]], doc_type: pa.DataType, row: Callable[[np.ndarray, list[int]], dict],
                     row_fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Record batches of sequences; ``row`` adds the columns of ``row_fields`` from the ids
    and the cumulative lengths of the pieces."""
    segment = pa.struct([("doc_id", doc_type), ("start", pa.int64()), ("length", pa.int64()),
                         ("doc_tokens", pa.int64()), ("offset", pa.int64())])
    schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("segments", pa.list_(segment)), *row_fields])
    number = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
    rows = []

    def flush():
        batch = pa.RecordBatch.from_pylist(rows, schema)
        rows.clear()
        return batch

    for pieces in sequences:
        ends = np.cumsum([len(p.ids) for p in pieces]).tolist()
        ids = np.concatenate([p.ids for p in pieces])
        rows.append({
            "sequence_id": number, "n_tokens": len(ids),
            "segments": [{"doc_id": p.doc_id, "start": p.start, "length": len(p.ids), "doc_tokens": p.total,
                          "offset": end - len(p.ids)} for p, end in zip(pieces, ends)],
            **row(ids, ends)})
        number += 1
        if len(rows) == BATCH_SEQUENCES:
            yield flush()
    if rows:
        yield flush()


def pack(docs: DataFrame, doc_id: str, text: str, run: Callable, extra: str) -> DataFrame:
    """``run(batches, arrow type of the ids)`` over every partition of (id, text)."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(narrow.schema["doc_id"].dataType)
    schema = (f"sequence_id bigint, n_tokens int, segments array<struct<doc_id:{kind},start:bigint,length:bigint,"
              f"doc_tokens:bigint,offset:bigint>>, {extra}")
    return narrow.mapInArrow(tidied(lambda batches: run(batches, arrow_kind)), schema)


def pieces_of(sequences: DataFrame, ids: str, *more: tuple[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per piece: where it came from, where it went and the CRC of its ids,
    cut out of the packed ids of its sequence."""
    def piece(s: Column) -> Column:
        cut = F.substring(F.col(ids), (s["offset"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int"))
        return F.struct(
            s["doc_id"].alias("doc_id"), s["start"].alias("start"), s["length"].alias("length"),
            F.crc32(cut).alias("ids_crc32"), s["doc_tokens"].alias("doc_tokens"),
            F.col("sequence_id").alias("sequence_id"), s["offset"].alias("offset"),
            *[make(s).alias(name) for name, make in more])

    return sequences.select(F.inline(F.transform("segments", piece)))
