"""Texts encoded in runs of whole pieces, against the tokenizers library."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from framegauge.llm import vocabulary as voc
from framegauge.llm.queries import TOKENIZER
from framegauge.llm.sequences import encoded_documents
from framegauge.llm.token_matrix import matrix_sequences

LATIN = ["word", " words", "It's", " ", "  ", "\n", ".", ", ", "1²", "é", " ßſ", "\x1c", "\x85", "\xa0", "ɏ", "’", "“", " —", "<|endoftext|>"]
FOREIGN = ["ɐ", "\u2028", " ‑‐", " ²⁰", "日本", " слово", "  ", " ", " 🙂", "́"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(TOKENIZER)

    def encode(text):
        return b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)

    return encode


def encoded(text):
    return b"".join(voc.library_encoder(TOKENIZER)(text))


def test_latin_texts_are_neither_split_nor_remembered(library):
    voc.held(("none",), lambda: None)
    encoder = voc.library_encoder(TOKENIZER)
    texts = ["".join(f" wörd{i}x{k}" for i in range(500)) for k in range(20)]
    assert [b"".join(encoder(t)) for t in texts] == list(map(library, texts))
    assert len(encoder(texts[0])) == 1 and not encoder.plain and not encoder.spaced


def test_foreign_pieces_go_by_themselves(library):
    voc.held(("none",), lambda: None)
    encoder = voc.library_encoder(TOKENIZER)
    assert b"".join(encoder("one two ъ  three “four” end")) == library("one two ъ  three “four” end")
    assert not {"one", "two", "three", "“four”", "end"} & {*encoder.spaced, *encoder.plain}
    choice = random.Random(6)
    for share in (0.05, 0.5, 0.95):
        for _ in range(1500):
            text = "".join(choice.choice(FOREIGN if choice.random() < share else LATIN) for _ in range(choice.randint(1, 30)))
            assert encoded(text) == library(text), text


def test_every_familiar_character_is_as_in_the_library(library):
    characters = [c for c in map(chr, range(0x3000)) if not voc.FOREIGN.search(c)]
    assert len(characters) > 0x250 + 60
    for c in characters:
        text = f"a{c}{c}b {c}c 1{c}2 .{c}. \n{c}\n  {c} {c}"
        assert encoded(text) == library(text), hex(ord(c))


@pytest.mark.parametrize("part", ["some words, and more ", "a  b   c\n  ", "it’s a text ", "a text of ъ and ɐ  words ", "много слов и ещё ", "x<|endoftext|> y "])
def test_long_texts_are_cut_where_pieces_begin(library, part):
    text = part * (3 * voc.RUN_CHARS // len(part))
    assert encoded(text) == library(text) and encoded(text + "end") == library(text + "end")


@pytest.mark.parametrize("piece", ["x", "\n", " ", "日", "é"])
def test_pieces_longer_than_a_run(library, piece):
    text = f"one two {piece * (voc.RUN_CHARS + 9)}three four"
    assert encoded(text) == library(text)


def test_a_million_spaces(library):
    text = "a" + " " * 1_100_000 + "b"
    assert encoded(text) == library(text)


def test_matrix_documents_leave_nothing_remembered(library):
    voc.held(("none",), lambda: None)
    texts = ["".join(f" wörd{i}x{k}" for i in range(300)) for k in range(5)] + ["", None]
    batch = pa.record_batch({"doc_id": list(range(7)), "text": pa.array(texts, pa.string())})
    sequences = list(matrix_sequences(encoded_documents([batch], TOKENIZER, 50256), 64, 1 << 22))
    found = {k: b"" for k in range(7)}
    for piece in sorted((p for s in sequences for p in s), key=lambda p: (p.doc_id, p.start)):
        assert piece.start * 4 == len(found[piece.doc_id])
        found[piece.doc_id] += piece.ids.tobytes()
    assert list(found.values()) == [library(t or "") + (50256).to_bytes(4, "little") for t in texts]
    encoder = voc.library_encoder(TOKENIZER)
    assert not encoder.plain and not encoder.spaced
