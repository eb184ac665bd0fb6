"""Whole-text encoding with a public tokenizer, one call of the library per distinct piece.

A vocabulary's pattern cuts a text into pieces before anything is merged, so the ids of a text are
the ids of its pieces put one after another. A worker keeps the ids of pieces it has met lately and asks
the tokenizers library for others only. Texts are cut at white space; a piece of common Latin characters that
isn't known is cut finely, by the vocabulary's own pattern, and the library's model merges each part; any other piece
goes through the whole library; texts with a character on whose class Python and the library disagree are encoded
whole. All ways give the library's ids of the whole text.
"""

from __future__ import annotations

import array
import re

#: Python's ``\\s`` has these, the library's has not.
_UNSURE = re.compile("[\x1c-\x1f]")
#: Any character outside those whose class, case and normal form are the same everywhere.
_NOT_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
#: The cutting patterns stated in the vocabularies' files, for plain characters.
_WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")
_BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
#: Pieces that these patterns leave whole, by far the most.
_WORD_LETTERS, _BYTE_LETTERS = re.compile("[a-zà-öø-ÿß]+"), re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: White-space pieces of a byte-level vocabulary: one blank belongs to the word after it.
_BLANK_JOINED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_NOT_BLANK = re.compile(r"\S+")
#: White space of which a byte-level vocabulary makes a piece of two characters or more; other blanks and line ends begin a piece.
_WIDE_BLANK = re.compile(r"\s\s(?!\S)")
#: The character that byte-level vocabularies write for each byte: printable ones for themselves, the rest from 256 on.
_BYTE_CHARS = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: Of longer texts the pieces are not listed all at once, which bounds a worker's memory.
CHUNK_CHARS = 2_000_000

#: Bytes of remembered pieces and their ids, for each of the two generations of a memory.
KEPT_BYTES = 40_000_000
#: What Python needs for an entry besides the characters and ids themselves.
_ENTRY_BYTES = 170

_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """This worker's encoder, kept from task to task; a worker holds the one of a single vocabulary."""
    if (path, kind) not in _encoders:
        _encoders.clear()
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]


class Pieces(dict):
    """ids of pieces of text, those not used for long forgotten.

    Two generations: pieces met since the last change, and before it. A piece of the old one moves to
    the new one when it is met; once the new one is full, it becomes the old one. So memory is bounded by
    twice ``most`` bytes, and frequent pieces stay.
    """

    def __init__(self, tokenizer, word: bool, most: int = KEPT_BYTES):
        self.tokenizer, self.model, self.word, self.most, self.size, self.old = tokenizer, tokenizer.model, word, most, 0, {}
        self.letters = (_WORD_LETTERS if word else _BYTE_LETTERS).fullmatch

    def _asked(self, piece: str) -> bytes:
        """ids of a piece that isn't known; what it is made of is remembered, too."""
        if not self.letters(piece):
            if _NOT_PLAIN.search(piece):
                return _ids(self.tokenizer, piece)
            parts = _WORD_PIECES.findall(piece.lower()) if self.word else _BYTE_PIECES.findall(piece)
            if parts != [piece]:
                return b"".join([self[x] for x in parts])
        if piece.isascii() and piece.isprintable():
            chars = piece.replace(" ", "\u0120")
        else:
            chars = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array.array("I", [x.id for x in self.model.tokenize(chars)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._asked(piece)
        self.size += _ENTRY_BYTES + len(piece) + len(ids)
        if self.size > self.most:
            self.old = self.copy()
            self.clear()
            self.size = 0
        self[piece] = ids
        return ids


class PieceEncoder:
    """ids of whole texts as little-endian unsigned 32-bit integers.

    ``kind``: ``"word"`` for a lower-casing vocabulary with word ends that drops white space,
    ``"byte"`` for a byte-level one. ``most`` bounds the bytes of pieces remembered.
    """

    def __init__(self, path: str, kind: str, most: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.word = kind == "word"
        self.pieces = Pieces(self.tokenizer, self.word, most)

    def encode(self, text: str) -> bytes:
        """ids of a text; an empty text has none."""
        if _UNSURE.search(text):
            return _ids(self.tokenizer, text)
        if len(text) > CHUNK_CHARS:
            cut = (m[0] for m in (_NOT_BLANK if self.word else _BLANK_JOINED).finditer(text))
        elif self.word:
            cut = text.lower().split() if not _NOT_PLAIN.search(text) else text.split()
        elif _WIDE_BLANK.search(text) or "\0" in text:
            cut = _BLANK_JOINED.findall(text)
        else:
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return b"".join(map(self.pieces.__getitem__, cut))


def _ids(tokenizer, text: str) -> bytes:
    return array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
