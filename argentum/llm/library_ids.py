"""Ids of whole texts as the tokenizers library gives them, as little-endian bytes.

The library encodes each distinct piece between two spaces once per worker
generation; a text is the concatenation of its pieces.  Where a cut at a space
could change the ids, the library encodes the whole text instead.
"""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache

import numpy as np

from . import bpe
from .common import cache_of, library


_LITTLE = sys.byteorder == "little"


class _Pieces(bpe.Memo):
    """Ids of pieces; a plain word, spelled in the vocabulary as ``before`` and itself, takes the shortest way."""

    def __init__(self, make, limit: int, tokenize, code: str, before: str):
        super().__init__(make, limit)
        self.tokenize, self.code, self.before, self.any_case = tokenize, code, before, bool(before)

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            if _LITTLE and piece.isalpha() and piece.isascii() and (self.any_case or piece.islower()):
                value = array(self.code, [t.id for t in self.tokenize(self.before + piece)]).tobytes()
            else:
                value = self.make(piece)
        self[piece] = value
        return value


class LibraryIds:
    """``encode(text) -> bytes``: ids of ``dtype`` without begin, end or added special tokens."""

    def __init__(self, path: str, dtype: str):
        self.lib, self.dtype, self.code = library(path), dtype, {"<u2": "H", "<u4": "I"}[dtype]
        spec = bpe.load(path)
        self.word_level, self.special = bool(spec.suffix), tuple(spec.special)
        self.model, self.alphabet = self.lib.model, bpe.byte_alphabet()
        self.space, self.marks = self.alphabet[0x20], (",", ".")
        self.words = bpe.Memo(self._pretoken, 100_000)
        make, limit, before = (self._word_piece, 250_000, "") if self.word_level else (self._byte_piece, 300_000, self.space)
        self.pieces = _Pieces(make, limit, self.model.tokenize, self.code, before)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if _LITTLE else np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.lib.encode(text, add_special_tokens=False).ids)

    def _pretoken(self, pretoken: str) -> bytes:
        """One pre-token, by the library's model alone: its bytes are spelled in the vocabulary's alphabet."""
        return self._spelled("".join([self.alphabet[b] for b in pretoken.encode()]))

    def _spelled(self, spelled: str) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(spelled)])

    def _word_piece(self, piece: str) -> bytes:
        """White space ends every pre-token of a word-end vocabulary, so any piece stands alone."""
        if piece.isascii() and piece.isalpha() and piece.islower():  # spelled as it is
            return self._spelled(piece)
        parts = bpe.word_and_tail(piece)
        if parts and (low := parts[0].lower()).isalpha():
            if low == piece:  # this cache is its only place
                return self._pretoken(low)
            return self.pieces[low] + (self.words[parts[1]] if parts[1] else b"")
        if "\n" in piece:
            return b"".join([self.pieces[x] for x in piece.split("\n")])
        return self.whole(piece) if piece else b""

    def _byte_piece(self, piece: str, before: str = " ") -> bytes | None:
        """A piece after ``before``; a single line feed between two non-spaces is a pre-token of its own."""
        if before == " " and piece.isascii():
            if piece.isalpha():  # spelled as it is, after a space
                return self._spelled(self.space + piece)
            if piece[-1:] in self.marks and piece[:-1].isalpha():
                return self.pieces[piece[:-1]] + self.words[piece[-1]]
        if parts := bpe.word_and_tail(piece):
            word, tail = parts
            if before != " ":
                return self.words[before + word] + (self.words[tail] if tail else b"")
            # a word after a space is kept among the pieces alone
            return self.pieces[word] + self.words[tail] if tail else self._pretoken(before + word)
        if not bpe.separable(piece, self.special):
            return None
        if "\n" in piece and "\n\n" not in piece:
            first, *rest = piece.split("\n")
            return b"".join([self._byte_piece(first, before), *(x for p in rest for x in (self.words["\n"], self._byte_piece(p, "")))])
        return self.whole(before + piece)

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        if self.word_level:
            return b"".join(map(self.pieces.__getitem__, parts))
        if len(parts) > 2 and bpe.separable(parts[0], self.special) and bpe.separable(parts[-1], self.special):
            try:
                return self.whole(parts[0]) + b"".join(map(self.pieces.__getitem__, parts[1:]))
            except TypeError:  # a piece that can't be cut out
                pass
        return self.whole(text)

    def turn(self) -> None:
        self.pieces.turn()
        self.words.turn()


@cache_of("library_ids")
@lru_cache(2)
def library_ids(path: str, dtype: str) -> LibraryIds:
    return LibraryIds(path, dtype)
