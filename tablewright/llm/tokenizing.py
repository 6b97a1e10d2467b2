"""Whole-text encoding with the tokenizers library, a piece between blanks at a time, each distinct piece once per worker.

Both vocabularies cut a text before their merges at every blank that has other characters on both sides, so the ids of a
text are the ids of its pieces in a row. A text in which a blank meets other white space is cut at the safe blanks only. A text
that holds the string of a special token is encoded by the library as a whole, which makes it that token.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

from tablewright.llm.common import worker_cache

#: Distinct pieces in each of the two generations that a worker keeps. A bound on memory only: others are encoded again.
CACHED_PIECES = 300_000
#: Characters that are a piece of their own after a word of letters, alone or in a row.
APART = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SAFE_BLANK = re.compile(r"(?<=\S)[ \n](?=\S)")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable in Latin-1, else 256 and on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


def lowered(word: str) -> str:
    """Composed, and lower-cased a character at a time."""
    return "".join(map(str.lower, unicodedata.normalize("NFC", word)))


class Known(dict):
    """The ids of pieces; ``make`` gives those that are missing."""

    def __init__(self, make):
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece) or self.make(piece)
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out


class PieceEncoder:
    """``encode(text)``: the ids as bytes, little-endian unsigned 32-bit. ``spaces``: blanks belong to the ids (byte-level vocabularies)."""

    def __init__(self, vocabulary: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)", re.I)
        self.tokenizer.model._resize_cache(0) if hasattr(self.tokenizer.model, "_resize_cache") else None
        self.word = self.tokenizer.model.tokenize  # the merges alone: for words of letters, which no earlier step cuts
        self.letters = byte_letters()
        self.spaces = spaces
        self.known = Known(self.new)

    def pieces(self, text: str) -> list[str]:
        words = text.split()
        if " ".join(words) == text.replace("\n", " ") and "\x01" not in text:  # no white space beside another
            return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01") if self.spaces else words
        if not self.spaces:
            return [x for x in re.split("[ \n]+", text) if x]
        out, at = [], 0
        for m in SAFE_BLANK.finditer(text):
            out.append(text[at : m.start()])
            at = m.start()
            if m[0] == "\n":
                out.append("\n")
                at += 1
        return [*out, text[at:]]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        return self.ids(text) if self.special.search(text) else b"".join(map(self.known.__getitem__, self.pieces(text)))

    def new(self, piece: str) -> bytes:
        if self.is_word(piece):
            return self.word_ids(piece)
        stem = piece.rstrip(APART)
        if stem != piece and self.is_word(stem):
            return self.known[stem] + self.known[piece[len(stem) :]]
        return self.ids(piece)

    def is_word(self, piece: str) -> bool:
        """Whether a piece, but for a blank before it, stays letters only; a capital can become a letter and a mark."""
        if self.spaces:
            return (piece[1:] if piece[:1] == " " else piece).isalpha()
        return piece.isalpha() and (piece.isascii() or lowered(piece).isalpha())

    def ids(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def word_ids(self, word: str) -> bytes:
        if not word.isascii():
            if not self.spaces:
                word = lowered(word)
            word = word.encode().decode("latin-1").translate(self.letters)
        elif self.spaces:
            word = word.replace(" ", self.letters[32])
        else:
            word = word.lower()
        return array("I", [x.id for x in self.word(word)]).tobytes()


def encoder(vocabulary: str, spaces: bool) -> PieceEncoder:
    """This worker's encoder."""
    cache, key = worker_cache("pieces"), ("encoder", vocabulary, spaces)
    if key not in cache:
        cache[key] = PieceEncoder(vocabulary, spaces)
    return cache[key]
