"""A byte-level BPE vocabulary file, and texts cut into pieces that can be encoded one by one."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex

from framegauge.llm.arrow import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Bytes of pieces that one worker remembers in a generation, about; the longest piece
# that is remembered; what an entry takes besides its key and value.
MEMO_BYTES = 48 << 20
MEMO_CHARS = 64
ENTRY_BYTES = 120

# Fixed value: how byte-level files split a text into pre-tokens.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Up to here the Unicode tables of all libraries agree.
LATIN_END = "\u0250"

# A space before another white-space character or the end of the text.
LOOSE_SPACE = re.compile(r" (?=\s|\Z)")
# A piece starts at a space that precedes a non-space.
PIECE = re.compile(r" \S(?:[^ ]| (?!\S))*+|(?:[^ ]| (?!\S))++")

# Characters encoded at a time, of a text's whole pieces; a longer piece goes by itself.
RUN_CHARS = 1 << 16
RUNS = re.compile(r"(?s:.{1,%d})(?= \S|\Z)|(?s:.)(?:[^ ]| (?!\S))*+" % RUN_CHARS)
# Characters that all libraries class alike: up to the Latin letters, and typographic marks.
FAMILIAR = r"!-\u024f\u2010-\u2027\u2030-\u205e"
FOREIGN = re.compile(rf"[^\0- {FAMILIAR}]")
# Adjoining pieces that hold another character.
FOREIGN_PIECES = re.compile(
    rf"((?:(?:\A| (?=\S))(?:[\0-\x1f{FAMILIAR}]| (?!\S))*+{FOREIGN.pattern}(?:[^ ]| (?!\S))*+)++)")


class Memo(dict):
    """Remembers ``compute`` for short keys, in bounded memory.

    When full, it becomes the old generation and a new one starts; keys still in use
    are taken over from the old one, all others go with it.
    """

    def __init__(self, compute: Callable, limit: int = MEMO_BYTES):
        super().__init__()
        self.compute, self.limit, self.size, self.old = compute, limit, 0, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= MEMO_CHARS:
            cost = ENTRY_BYTES + (len(key) if key.isascii() else 4 * len(key)) + (len(value) if isinstance(value, bytes) else 8)
            if self.size + cost > self.limit:
                self.old, self.size = dict(self), 0
                self.clear()
            self.size += cost
            self[key] = value
        return value


class PieceMap:
    """Values of a text's pieces, in order.

    Byte-level splitting puts a space in front of the token that follows it, so a
    space before a non-space always starts a token and what lies on either side can
    be encoded by itself.  ``split`` cuts a piece into pre-tokens; a piece of one
    pre-token has the value ``word(piece)``, others have ``join`` of their values.
    Strings of added tokens are cut out first, as the library does; their values are
    in ``special``.
    """

    def __init__(self, split: Callable, word: Callable, join: Callable, special: dict, memo_bytes: int = MEMO_BYTES):
        self.split, self.word, self.join, self.special = split, word, join, special
        # Few pieces have no space before them.
        self.plain = Memo(self._value, memo_bytes // 4)
        self.spaced = Memo(lambda piece: self._value(" " + piece), memo_bytes)
        names = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None

    def _value(self, piece: str):
        words = self.split(piece)
        if len(words) == 1:
            return self.word(piece)
        return self.join([self.spaced[w[1:]] if w[0] == " " and len(w) > 1 else self.plain[w] for w in words])

    def __call__(self, text: str | None) -> list:
        if not text:
            return []
        if self.cut and any(name in text for name in self.special):
            values = []
            for part in self.cut(text):
                values += [self.special[part]] if part in self.special else self._between(part)
            return values
        return self._between(text)

    def _between(self, text: str) -> list:
        if not text:
            return []
        if LOOSE_SPACE.search(text):
            return list(map(self.plain.__getitem__, PIECE.findall(text)))
        first, *rest = text.split(" ")
        values = [self.plain[first]] if first else []
        values.extend(map(self.spaced.__getitem__, rest))
        return values


class RunMap(PieceMap):
    """A piece map that takes pieces of familiar characters many at a time: ``run`` gives
    the value of a stretch of them, so they need neither splitting nor remembering."""

    def __init__(self, run: Callable, *pieces):
        super().__init__(*pieces)
        self.run = run

    def _between(self, text: str) -> list:
        if not text:
            return []
        values = []
        for stretch in RUNS.findall(text) if len(text) > RUN_CHARS else [text]:
            if len(stretch) > RUN_CHARS:
                values += super()._between(stretch)
            elif stretch.isascii() or not FOREIGN.search(stretch):
                values.append(self.run(stretch))
            else:
                for k, part in enumerate(FOREIGN_PIECES.split(stretch)):
                    if part:
                        values += super()._between(part) if k % 2 else [self.run(part)]
        return values


class Vocabulary:
    """Merges, token bytes and added tokens of a byte-level BPE file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        ids: dict[str, int] = content["model"]["vocab"]
        self.shift = max(ids.values()).bit_length() + 1
        self.special: dict[str, int] = {t["content"]: t["id"] for t in content["added_tokens"]}
        # Keyed by both ids in one integer, with the rank and the id of the result in another.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[left] << self.shift | ids[right], rank << self.shift | ids[left + right])
        alphabet = byte_alphabet()
        self.byte_ids = [ids.get(c, -1) for c in sorted(alphabet, key=alphabet.get)]
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()

    def split(self, piece: str) -> list[str]:
        """The pre-tokens of a piece.

        Beyond the Latin letters the library decides, whose Unicode tables are of
        another version than those of the regex module.
        """
        if max(piece) < LATIN_END:
            # Mostly a word, with or without the space before it.
            if (piece[1:] if piece[0] == " " else piece).isalpha():
                return [piece]
            return self.pattern.findall(piece)
        return [piece[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def ranked(self):
        """The vocabulary as a tiktoken encoding; None if merges are not in the order of ids."""
        import tiktoken

        results = [merge & ((1 << self.shift) - 1) for merge in self.merges.values()]
        if any(b <= a for a, b in zip(results, results[1:])) or -1 in self.byte_ids or max(self.byte_ids) > results[0]:
            return None
        ranks = {self.token_bytes[i]: i for i in [*self.byte_ids, *results]}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def symbols(self, word: str) -> list[int]:
        return list(map(self.byte_ids.__getitem__, word.encode()))


def byte_alphabet() -> dict[str, int]:
    """Byte-level files write a byte as its Latin-1 character if that is visible;
    the others take the code points from 256 on, in order."""
    visible = {b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One copy per worker process."""
    return Vocabulary(path)


def library_encoder(path: str, memo_bytes: int = MEMO_BYTES) -> PieceMap:
    """Texts as ``tokenizers`` encodes them: little-endian 32-bit ids as bytes.

    Pieces of familiar characters go through tiktoken with the same merges, many at a
    time, if these can be written as ranks of their results: it makes the same ids in a
    fraction of the time.
    """
    return held(("library", path, memo_bytes), lambda: _library_encoder(path, memo_bytes))


def _library_encoder(path: str, memo_bytes: int) -> PieceMap:
    words = vocabulary(path)
    encode, ranked = words.tokenizer.encode, words.ranked()

    def as_bytes(ids: list[int]) -> bytes:
        values = array("I", ids)
        if sys.byteorder == "big":
            values.byteswap()
        return values.tobytes()

    def run(text: str) -> bytes:
        return as_bytes(ranked.encode_ordinary(text))

    def word(piece: str) -> bytes:
        # tiktoken gives up on a million white-space characters.
        if ranked is not None and len(piece) <= RUN_CHARS and max(piece) < LATIN_END:
            return run(piece)
        return as_bytes(encode(piece, add_special_tokens=False).ids)

    pieces = words.split, word, b"".join, {name: as_bytes([i]) for name, i in words.special.items()}, memo_bytes
    return PieceMap(*pieces) if ranked is None else RunMap(run, *pieces)
