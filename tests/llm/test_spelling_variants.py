"""The FM-index and the variants it finds, against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from framegauge.llm import spelling_variants as sv
from framegauge.llm.queries import op11_spelling_variants

SF = "/root/testdata/sf0.001"


def one_edit(word, alphabet):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in alphabet)
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + c + word[i + 1:] for c in alphabet)


def brute(counts):
    """{word: (n, n_near, form, form_n, root)} through all edited words."""
    alphabet = sorted(set("".join(counts)))
    out = {}
    for word, n in counts.items():
        near = {w for w in one_edit(word, alphabet) if w in counts and w != word}
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        out[word] = (n, len(near), best if best and counts[best] >= 2 * n else None)
    def root(w):
        return w if out[w][2] is None else root(out[w][2])
    return {w: (n, k, form, counts.get(form), root(w)) for w, (n, k, form) in out.items()}


def test_index_counts_and_sides():
    words = sorted({"".join(w) for w in product("abc", repeat=3)} | {"ab", "abcab", "é", "\U0001f600b"})
    index = sv.BidirectionalIndex(words)
    circles = [f"${w}" * 3 for w in words]
    for pattern in ("a", "ab", "$a", "b$", "ab$", "$ab$", "ca", "zz"):
        f = b = np.zeros(1, dtype=np.int64)
        size = np.full(1, index.size)
        for c in pattern:
            symbol = np.zeros(1, dtype=np.int64) if c == "$" else index.codes(c)
            b, f, size = index.extend(index.right, b, f, size, symbol)
        f2 = b2 = np.zeros(1, dtype=np.int64)
        size2 = np.full(1, index.size)
        for c in reversed(pattern):
            symbol = np.zeros(1, dtype=np.int64) if c == "$" else index.codes(c)
            f2, b2, size2 = index.extend(index.left, f2, b2, size2, symbol)
        want = sum(circle.startswith(pattern, i) for w, circle in zip(words, circles) for i in range(len(w) + 1))
        assert size[0] == size2[0] == want
        assert not want or (f[0], b[0]) == (f2[0], b2[0])


@pytest.mark.parametrize("letters, longest", [("ab", 8), ("abcdé", 6)])
def test_both_schemes_find_every_neighbour_once(letters, longest):
    choice = random.Random(4)
    words = sorted({"".join(choice.choices(letters, k=choice.randint(1, longest))) for _ in range(400)})
    other = ["".join(choice.choices(letters + "z", k=5)) for _ in range(50)]
    queries = sorted({*choice.sample(words, len(words) // 2), *other})
    got = Counter()
    for backwards in (False, True):
        turn = (lambda w: w[::-1]) if backwards else (lambda w: w)
        turned = sorted(map(turn, words))
        index = sv.BidirectionalIndex(turned)
        asked = list(map(turn, queries))
        ends = np.cumsum([len(w) for w in asked])
        starts = ends - [len(w) for w in asked]
        halves = starts + [sv.first_half(len(w), backwards) for w in asked]
        q, w = index.neighbours(index.codes("".join(asked) + "\0"), starts, halves, ends, np.array([w in set(words) for w in queries]), backwards)
        got.update((queries[a], words[words.index(turn(turned[b]))]) for a, b in zip(q.tolist(), w.tolist()))
    want = Counter()
    for query in queries:
        want.update({(query, w) for w in set(one_edit(query, letters)) if w in set(words) and w != query})
    assert got == want


@pytest.mark.parametrize("block_words", [40, 1 << 15])
def test_variants_against_brute_force(spark, block_words):
    choice = random.Random(6)
    counts = {}
    for _ in range(500):
        word = "".join(choice.choices("abn", k=choice.randint(1, 7)))
        counts[word] = choice.choice([1, 2, 3, 5, 9, 20, 45, 100, 100])
    counts |= {"prefix" + w: n for w, n in list(counts.items())[:150]} | {"x" * 3000: 9, "x" * 2999: 2, "über": 4, "uber": 2, "": 3}
    rows = [(w, n, "?") for w, n in counts.items()] + [(None, 5, "?"), ("aban", None, "?"), ("aban", 2, "?")]
    counts["aban"] = counts.get("aban", 0) + 2
    df = spark.createDataFrame(rows, "word string, n bigint, root string").repartition(4)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in sv.spelling_variants(df, block_words=block_words).collect()}
    assert got == brute(counts)


def test_no_words(spark):
    assert sv.spelling_variants(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_counted_runs(spark):
    docs = [(1, "Abc déF abc-ABC x" + "y" * 9), (None, "abcde ÀB×c"), (3, None), (4, ""), (4, "ab " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["word"]: r["n"] for r in sv.counted_runs(df, least_chars=1).collect()}
    assert got == {"abc": 3, "déf": 1, "x" + "y" * 9: 1, "abcde": 1, "Àb×c": 1, "ab": 50_000}


def test_query(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if code % 97 == 0:
                run = run[:code % len(run)] + run[code % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in op11_spelling_variants(spark, SF).collect()}
    assert got == brute(counts)
