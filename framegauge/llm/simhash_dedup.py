"""SimHash near-duplicates by a byte-position inverted index."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.llm.components import connected_components, spanning_edges
from framegauge.llm.arrow import row_slices
from framegauge.session import checkpointed

BYTES = 8
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 16
# Positional bytes that the members of a list share.
SHARED = 4
# Lists of more fingerprints than this are told apart by further bytes.
LIST_ROWS = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, each counted as often as it occurs.

    Words are separated by ASCII white space after lower-casing A-Z.  A text of fewer
    words is one shingle; a text without words, like a null one, has 0.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed 64-bit integer."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            for rows in row_slices(batch):
                values = np.array([fingerprint(t, shingle) for t in rows.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def byte_order(distinct: DataFrame) -> np.ndarray:
    """Place of every (position, byte) among all, the rarest first: 8 x 256 numbers.

    The counts are combined in the tasks; at most 2,048 of them reach the driver.
    """
    octets = F.array(*[F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)])
    counts = np.zeros(BYTES * 256, np.int64)
    for position, octet, rows in distinct.select(F.posexplode(octets)).groupBy("pos", "col").count().collect():
        counts[position * 256 + octet] = rows
    order = np.empty(BYTES * 256, np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(BYTES * 256)
    return order.reshape(BYTES, 256)


def byte_masks(positions: np.ndarray) -> np.ndarray:
    """Masks over fingerprints of sets of byte positions, one set a row."""
    return np.bitwise_or.reduce(np.uint64(255) << (np.uint64(8) * positions.astype(np.uint64)), axis=1)


def prefix_lists(values: np.ndarray, order: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of every fingerprint: (fingerprint x lists) masks of positions, and the bytes there.

    ``max_bits`` differing bits spoil at most as many of the eight positional bytes, so
    a linked pair shares at least 8 - max_bits.  In one order of all (position, byte)
    the ``SHARED`` foremost shared ones are among the foremost max_bits + SHARED of
    either side, since at most max_bits others come between.
    """
    octets = values.view(np.uint8).reshape(-1, BYTES)
    rarest = np.argsort(order[np.arange(BYTES), octets], axis=1)[:, :max_bits + SHARED]
    masks = np.stack([byte_masks(rarest[:, list(c)]) for c in combinations(range(max_bits + SHARED), SHARED)], axis=1)
    return masks, values[:, None] & masks


def differing_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of each 64-bit number are not zero."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(((x & low) + low | x) & ~low)


def list_edges(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning edges (indexes) of one list of distinct fingerprints.

    The shared positional bytes of each pair are tallied, pairs that reach the
    guaranteed minimum are retained, and their bits are compared.
    """
    def links(i: int) -> list[int]:
        other = values ^ values[i]
        retained = np.flatnonzero(BYTES - differing_bytes(other) >= BYTES - max_bits)
        return retained[np.bitwise_count(other[retained]) <= max_bits].tolist()

    return spanning_edges(links, range(len(values)))


def postings(distinct: DataFrame, order: np.ndarray, max_bits: int) -> DataFrame:
    """(mask, key, fp, rep): every fingerprint in its lists."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                fp, rep = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "rep"))
                masks, keys = prefix_lists(np.ascontiguousarray(fp).view(np.uint64), order, max_bits)
                each = masks.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(masks.ravel().view(np.int64)), pa.array(keys.ravel().view(np.int64)),
                    pa.array(np.repeat(fp, each)), pa.array(np.repeat(rep, each))], ["mask", "key", "fp", "rep"])

    return distinct.select("fp", "rep").mapInArrow(run, "mask bigint, key bigint, fp bigint, rep bigint")


def longer_lists(posted: DataFrame, max_bits: int) -> DataFrame:
    """The same members under every minimum of shared bytes that holds their list's bytes.

    Such a list fixes 8 - max_bits bytes, so it has at most 65,536 members for two bits.
    """
    everywhere = [sum(255 << 8 * p for p in c) for c in combinations(range(BYTES), BYTES - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in everywhere]
    wider = F.filter(F.array(*[F.lit(m).cast("bigint") for m in signed]), lambda m: m.bitwiseAND(F.col("mask")) == F.col("mask"))
    return posted.select(F.explode(wider).alias("mask"), "fp", "rep").select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep").distinct()


def near_edges(distinct: DataFrame, max_bits: int = 2, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints, enough to connect all that are linked.

    ``distinct`` has one row per fingerprint: fp and rep.  The inverted index holds the
    rarest positional bytes of each, four to a list (15 lists for two bits): lists of
    single bytes would hold a 256th of all rows each.  Pairs of a list are tallied over
    all eight positions, retained from the guaranteed minimum on, and verified.  Lists
    of more than ``list_rows`` are counted before anything is collected and go on to the
    longer lists of ``longer_lists``, which are bounded; the tally there is the same.
    Pairs never leave the task: it returns a spanning forest of its links.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("lists are bounded for at most two differing bits")
    posted = postings(distinct, byte_order(distinct), max_bits)
    sizes = checkpointed(posted.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    listed = posted.join(sizes, ["mask", "key"])
    short = listed.where(F.col("size") <= list_rows).drop("size")
    lists = short.union(longer_lists(listed.where(F.col("size") > list_rows), max_bits)).groupBy("mask", "key").agg(
        F.collect_list(F.struct("fp", "rep")).alias("items")).where(F.size("items") > 1)

    def run(batches):
        for batch in batches:
            items = batch.column(0)
            ends = items.offsets.to_numpy()
            values = items.values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            reps = items.values.field("rep").to_numpy(zero_copy_only=False)
            edges = [(i + at, j + at) for at, end in zip(ends[:-1].tolist(), ends[1:].tolist())
                     for i, j in list_edges(values[at:end], max_bits)]
            left, right = np.array(edges, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(reps[left]), pa.array(reps[right])], ["a", "b"])

    return lists.select("items").mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row with integer ids.

    Fingerprints link when at most ``max_bits`` bits differ; component_id is the
    smallest doc_id that can be reached, its own included.  Equal fingerprints are one
    vertex, so copies cost nothing however many there are.  Texts without words have
    fingerprint 0 and are linked like any other.  Rows with equal ids keep one row
    each; a null id can be reached but is never the smallest, and where a whole
    component has none its component_id is null.  Other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, doc_id, text, shingle))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("rep")))
    linked = connected_components(near_edges(distinct.where("rep is not null"), max_bits), "a", "b")
    classes = checkpointed(distinct.join(linked, distinct["rep"] == linked["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
