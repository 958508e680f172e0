"""Spelling variants: words one edit apart, found by bidirectional FM-index search schemes.

An edit leaves one half of a word as it is.  So a word's neighbours either begin with
its first half, or end with its second half, and each half has a search scheme: match
the half exactly, out of the middle to the delimiter at the word's end, then go on
across the other half allowing one error, up to the other delimiter.  The index over a
block of the vocabulary holds every rotation of the delimited words in order, forwards
and backwards; a pattern is an interval of ranks in both, and a wavelet matrix over each
Burrows-Wheeler string extends it by a symbol on either side.

Words that begin alike are neighbours in the sorted vocabulary, so a block is a range of
it, and a query goes to the blocks that hold its first half: mostly its own one.  The
scheme of the second half does the same with the reversed words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.functions.columns import quoted
from framegauge.llm.arrow import row_slices
from framegauge.session import checkpointed

# Fixed value: runs of letters, in text with A-Z in lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
# Words of an index block, and queries searched at a time.
BLOCK_WORDS = 1 << 15
QUERY_ROWS = 1 << 13
# Distinct words counted by a task before it hands them on.
COUNTED_WORDS = 300_000
LAST_CHAR = "\U0010ffff"


class WaveletMatrix:
    """Ranks and smaller symbols in ranges of a string of small numbers, for many ranges at a time."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for bit in reversed(range(max(1, (n_symbols - 1).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            zeros_before = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(~ones, out=zeros_before[1:])
            self.levels.append((bit, zeros_before))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        # Where the symbols of the string stand in order, less where this matrix leaves them.
        every = np.arange(n_symbols)
        starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))[:-1]])
        self.shift = np.zeros(n_symbols, dtype=np.int64)
        low, _, _ = self.descend(np.zeros(n_symbols, dtype=np.int64), np.zeros(n_symbols, dtype=np.int64), every)
        self.shift = starts - low

    def descend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each range: the range of the rows that ``symbol`` precedes, and the symbols in it that are smaller."""
        smaller = np.zeros(len(low), dtype=np.int64)
        for bit, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            zero_low, zero_high, all_zeros = zeros[low].astype(np.int64), zeros[high].astype(np.int64), int(zeros[-1])
            smaller += np.where(one, zero_high - zero_low, 0)
            low = np.where(one, all_zeros + low - zero_low, zero_low)
            high = np.where(one, all_zeros + high - zero_high, zero_high)
        shift = self.shift[symbol]
        return low + shift, high + shift, smaller

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols of each range: (range, symbol, range of their rows, smaller symbols)."""
        owner = np.arange(len(low))
        symbol, smaller = np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=np.int64)
        for bit, zeros in self.levels:
            zero_low, zero_high, all_zeros = zeros[low].astype(np.int64), zeros[high].astype(np.int64), int(zeros[-1])
            one_low, one_high = all_zeros + low - zero_low, all_zeros + high - zero_high
            zero, one = zero_high > zero_low, one_high > one_low
            owner = np.concatenate([owner[zero], owner[one]])
            smaller = np.concatenate([smaller[zero], (smaller + zero_high - zero_low)[one]])
            symbol = np.concatenate([symbol[zero], symbol[one] | 1 << bit])
            low, high = np.concatenate([zero_low[zero], one_low[one]]), np.concatenate([zero_high[zero], one_high[one]])
        shift = self.shift[symbol]
        return owner, symbol, low + shift, high + shift, smaller


def rotation_order(symbols: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Positions in order of what is read from them on, going round in each word; by prefix doubling."""
    rank, step = symbols.astype(np.int64), after
    while True:
        pair = rank * (int(rank.max()) + 1) + rank[step]
        order = np.argsort(pair, kind="stable")
        new = np.empty(len(rank), dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        if int(new.max()) == len(new) - 1:
            return order
        rank, step = new, step[step]


class BidirectionalIndex:
    """FM-indexes of the delimited words, read forwards and backwards, with common intervals.

    An interval (forward rank, backward rank, size) stands for all places where a
    pattern occurs.  Ranks of the delimiter are the numbers of the words in order.
    """

    def __init__(self, words: list[str]):
        """``words`` are distinct and in order of code points."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.alphabet = np.unique(points)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        n = len(points) + len(words)
        symbols = np.zeros(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[starts] = False
        symbols[inside] = np.searchsorted(self.alphabet, points) + 1
        after = np.arange(1, n + 1)
        after[starts + lengths] = starts
        before = np.empty(n, dtype=np.int64)
        before[after] = np.arange(n)
        self.size, self.n_symbols = n, len(self.alphabet) + 1
        forward, backward = rotation_order(symbols, after), rotation_order(symbols, before)
        self.left = WaveletMatrix(symbols[before[forward]], self.n_symbols)
        self.right = WaveletMatrix(symbols[after[backward]], self.n_symbols)

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text; one beyond the alphabet for characters that no word has."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        if not len(self.alphabet):
            return np.full(len(points), self.n_symbols)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, self.n_symbols)

    def extend(self, matrix: WaveletMatrix, own: np.ndarray, other: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals of the patterns with ``symbol`` on ``matrix``'s side; ``own`` ranks are those it moves in."""
        known = symbol < self.n_symbols
        low, high, smaller = matrix.descend(own, own + size, np.where(known, symbol, 0))
        return low, other + smaller, np.where(known, high - low, 0)

    def neighbours(self, codes: np.ndarray, starts: np.ndarray, halves: np.ndarray, ends: np.ndarray, at_home: np.ndarray,
                   elsewhere: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for all words one edit away from a query that share its first half.

        Query k is ``codes[starts[k]:ends[k]]`` and its first half ends before
        ``halves[k]``; ``at_home`` says that the query itself is among the words.
        With ``elsewhere``, words that could as well have been found through the
        second half are left out.

        Every way to a word is taken once: of a run of equal symbols the last one is
        deleted, and symbols are inserted behind the run they would prolong.
        """
        n = len(starts)
        zero = np.zeros(n, dtype=np.int64)
        forward, backward, size = zero, zero.copy(), np.full(n, self.size)
        # The first half, from the middle to the delimiter.
        for k in range(int((halves - starts).max(initial=0)) + 1):
            at = halves - 1 - k
            live = np.flatnonzero((at >= starts - 1) & (size > 0))
            symbol = np.where(at[live] >= starts[live], codes[np.maximum(at[live], 0)], 0)
            forward[live], backward[live], size[live] = self.extend(self.left, forward[live], backward[live], size[live], symbol)
        # Lengths of the stretch behind the middle that equals its first symbol, or the last one before it.
        run = self._stretch(codes, halves, ends, codes[np.minimum(halves, len(codes) - 1)])
        across = self._stretch(codes, halves, ends, codes[halves - 1])
        exact = (np.arange(n), forward, backward, size)
        wrong = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        found = []
        for i in range(int((ends - halves).max(initial=0)) + 1):
            # ``exact`` has matched the first i symbols; a range of one row is the query itself.
            q, forward, backward, size = exact
            live = (size > at_home[q]) & (halves[q] + i <= ends[q])
            q, forward, backward, size = q[live], forward[live], backward[live], size[live]
            last = halves[q] + i == ends[q]
            here = np.where(last, -1, codes[np.minimum(halves[q] + i, len(codes) - 1)])
            owner, symbol, low, high, smaller = self.right.children(backward, backward + size)
            child = (q[owner], forward[owner] + smaller, low, high - low)
            on, letter, ended = symbol == here[owner], symbol > 0, last[owner]
            # The other half decides alone where it would find the same word.
            prolongs = (symbol == codes[np.minimum(halves[q], len(codes) - 1)][owner]) & (i <= run[q][owner]) & (i > 0)
            double = ((i == 0) | prolongs) if elsewhere else np.zeros(len(symbol), dtype=bool)
            inserted = letter & ~on & ~double
            replaced = letter & ~on & ~ended
            following = np.where(halves[q] + i + 1 < ends[q], codes[np.minimum(halves[q] + i + 1, len(codes) - 1)], -1)
            deleted = ~last & (following != here)
            if elsewhere:
                deleted &= i >= across[q]
            wrong = self._join(wrong, [part[inserted] for part in child])
            # What has had its error goes on exactly, to the delimiter where the query ends.
            w, forward_w, backward_w, size_w = wrong
            done = halves[w] + i == ends[w]
            step = np.where(done, 0, codes[np.minimum(halves[w] + i, len(codes) - 1)])
            own, other, left = self.extend(self.right, backward_w, forward_w, size_w, step)
            full = left > 0
            found.append((w[done & full], other[done & full]))
            onward = ~done & full
            wrong = (w[onward], other[onward], own[onward], left[onward])
            wrong = self._join(wrong, [part[replaced] for part in child], [part[deleted] for part in (q, forward, backward, size)])
            exact = tuple(part[on & ~ended] for part in child)
        query, word = (np.concatenate(column) for column in zip(*found))
        return query, word

    @staticmethod
    def _join(*parts) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(column) for column in zip(*parts))

    @staticmethod
    def _stretch(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        length = np.zeros(len(starts), dtype=np.int64)
        live = np.arange(len(starts))
        while len(live):
            at = starts[live] + length[live]
            live = live[(at < ends[live]) & (codes[np.minimum(at, len(codes) - 1)] == symbol[live])]
            length[live] += 1
        return length


def _frames(rows: Iterable[tuple], schema: pa.Schema, size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def counted_runs(docs: DataFrame, least_chars: int = 5, damaged_mod: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): how often each run of letters occurs in all texts, A-Z in lower case.

    With ``damaged_mod``, runs lose a character where it divides the CRC-32 of
    ``<id>:<run>``: made-up misspellings.  Only words of ``least_chars`` are returned.
    Null texts have no words, a null id is written as nothing.  A task combines its
    counts before they are shuffled by word, a few hundred thousand words at a time.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def words(batches):
        total: dict[str, int] = {}
        for batch in batches:
            for rows in row_slices(batch):
                for key, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    if not content:
                        continue
                    # Bytes know no other case than that of A-Z.
                    runs = Counter(RUN.findall(content.encode().lower().decode()))
                    start = crc32(f"{key or ''}:".encode())
                    for word, n in runs.items():
                        if damaged_mod and not (code := crc32(word.encode(), start)) % damaged_mod:
                            at = code % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= least_chars:
                            total[word] = total.get(word, 0) + n
            if len(total) >= COUNTED_WORDS:
                yield from _frames(total.items(), schema)
                total.clear()
        yield from _frames(total.items(), schema)

    narrow = docs.select(quoted(doc_id).cast("string").alias("doc_id"), quoted(text).alias("text"))
    return narrow.mapInArrow(words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _routed(starts: list[str], numbers: list[int], offset: int, backwards: bool):
    """Every word of a block as a row of its index, and as a query to all blocks with its first half."""
    schema = pa.schema([("block", pa.int64()), ("query", pa.bool_()), ("word", pa.string()), ("n", pa.int64()), ("home", pa.bool_())])

    def rows(batches):
        for batch in batches:
            for block, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                yield block + offset, False, word, n, True
                half = word[:first_half(len(word), backwards)]
                last = bisect_right(starts, half + LAST_CHAR)
                for number in numbers[max(0, bisect_right(starts, half) - 1):last]:
                    yield number + offset, True, word, n, number == block

    return lambda batches: _frames(rows(batches), schema)


def first_half(length: int, backwards: bool) -> int:
    return length - length // 2 if backwards else length // 2


def _searched(offset: int):
    """Neighbours of the queries of each block: how many, and the most frequent."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(batches):
        block, words, counts, index, ties, waiting = None, [], [], None, None, []

        def answers():
            nonlocal index, ties, words, counts
            backwards = block >= offset
            if index is None:
                order = sorted(range(len(words)), key=words.__getitem__)
                words, counts = [words[i] for i in order], np.array([counts[i] for i in order], dtype=np.int64)
                index = BidirectionalIndex(words)
                # Ties go to the smallest word, whichever way it is read.
                ties = np.empty(len(words), dtype=np.int64)
                ties[sorted(range(len(words)), key=lambda i: words[i][::-1] if backwards else words[i])] = np.arange(len(words))
            queries = [word for word, _ in waiting]
            lengths = np.fromiter(map(len, queries), dtype=np.int64, count=len(queries))
            ends = np.cumsum(lengths)
            starts = ends - lengths
            halves = starts + (lengths - lengths // 2 if backwards else lengths // 2)
            query, word = index.neighbours(index.codes("".join(queries) + "\0"), starts, halves, ends,
                                           np.array([home for _, home in waiting]), backwards)
            waiting.clear()
            if not len(query):
                return
            order = np.lexsort((ties[word], -counts[word], query))
            query, word = query[order], word[order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            n_near = np.diff(np.append(first, len(query)))
            turn = (lambda w: w[::-1]) if backwards else (lambda w: w)
            yield pa.RecordBatch.from_arrays([
                pa.array([turn(queries[q]) for q in query[first].tolist()], pa.string()), pa.array(n_near, pa.int64()),
                pa.array(counts[word[first]], pa.int64()), pa.array([turn(words[w]) for w in word[first].tolist()], pa.string())], schema=schema)

        for batch in batches:
            for number, is_query, word, n, home in zip(*(column.to_pylist() for column in batch.columns)):
                if number != block:
                    if waiting:
                        yield from answers()
                    block, words, counts, index, ties = number, [], [], None, None
                if is_query:
                    waiting.append((word, home))
                    if len(waiting) == QUERY_ROWS:
                        yield from answers()
                else:
                    words.append(word)
                    counts.append(n)
        if waiting:
            yield from answers()

    return run


def _followed(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling the stretch that is followed."""
    up = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("w"), F.col("root").alias("r"))
        nearer = up.join(further, up["root"] == further["w"], "left")
        up = checkpointed(nearer.select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            return up.select("word", "root")
        up = up.select("word", "root")


def spelling_variants(words: DataFrame, word: str = "word", n: str = "n", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of counted words.

    Two words are near if one inserted, deleted or replaced character tells them apart.
    ``form`` is the near word of largest n (ties: the smallest), if that is at least
    twice the word's own n, else null; ``root`` is where the forms lead, the word itself
    if it has none.

    Null words are left out, counts of equal words are added up, null counts are 0;
    other columns play no part; no words give no rows.  Words may have any characters
    and any length.  A task holds the index of one block of about ``block_words`` words;
    queries stream past it.  The driver holds one word per block.
    """
    vocabulary = checkpointed(words.select(quoted(word).alias("word"), F.coalesce(quoted(n), F.lit(0)).cast("bigint").alias("n"))
                              .where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    blocks = max(1, -(-vocabulary.count() // block_words))
    rows, total = None, 0
    for backwards in (False, True):
        key = F.reverse("word") if backwards else F.col("word")
        placed = checkpointed(vocabulary.select(key.alias("word"), "n").repartitionByRange(blocks, "word").select(
            F.spark_partition_id().cast("bigint").alias("block"), "word", "n"))
        bounds = sorted((r["start"], r["block"]) for r in placed.groupBy("block").agg(F.min("word").alias("start")).collect())
        routed = placed.mapInArrow(_routed([s for s, _ in bounds], [b for _, b in bounds], total, backwards),
                                   "block bigint, query boolean, word string, n bigint, home boolean")
        rows, offset = (routed, 0) if rows is None else (rows.unionByName(routed), total)
        total += max((b for _, b in bounds), default=0) + 1
    found = rows.repartition(2 * total, "block").sortWithinPartitions("block", "query").mapInArrow(
        _searched(offset), "word string, n_near bigint, best_n bigint, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    told = checkpointed(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("b.m") >= 2 * F.col("n"), F.struct(F.col("b.best").alias("form"), (-F.col("b.m")).alias("form_n"))).alias("f")))
    told = told.select("word", "n", "n_near", "f.form", "f.form_n")
    roots = _followed(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
