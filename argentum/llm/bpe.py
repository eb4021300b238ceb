"""Byte-pair encoding from a vocabulary file: merge queue, whole-token proof, decoding.

The encoder keeps the symbols of a pre-token in a doubly linked list and the
mergeable neighbours in a heap of (rank, position).  A heap entry is stale when
either side has been merged since it was pushed; stale entries are skipped when
they surface instead of being searched for and removed.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import regex


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and special tokens of a tokenizers ``.json`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        ids = self.vocab
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = a + b
            self.merges[ids[a], ids[b]] = (rank, ids[joined])
        alphabet = byte_alphabet()
        self.byte_id = [ids.get(c) for c in alphabet]
        self.last_byte_id = [ids.get(c + self.suffix) for c in alphabet]

    def symbols(self, data: bytes) -> list[int]:
        """Ids of the single bytes of a pre-token; the last one carries the word end, if there is one."""
        out = [self.byte_id[b] for b in data]
        if out and self.suffix:
            out[-1] = self.last_byte_id[data[-1]]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one pre-token, lowest rank first, leftmost first among equals."""
        n = len(ids)
        merges = self.merges
        if n < 2:
            return ids
        heap = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        if not heap:
            return ids
        heapq.heapify(heap)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, new, a, b = pop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: a neighbour has been merged meanwhile
            ids[i] = new
            ids[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                m = merges.get((new, ids[k]))
                if m:
                    push(heap, (m[0], i, m[1], new, ids[k]))
            h = left[i]
            if h >= 0:
                m = merges.get((ids[h], new))
                if m:
                    push(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.merge(self.symbols(data))

    def whole_tokens(self) -> frozenset[bytes]:
        """Byte strings of the vocabulary that encode alone as exactly one token.

        A vocabulary entry need not be reachable: its own merge may be pre-empted
        by a lower rank inside it.  So every entry is merged once, offline, and
        kept only where one id, its own, is left.
        """
        back = {c: b for b, c in enumerate(byte_alphabet())}
        kept = []
        for s, i in self.vocab.items():
            body = s[: -len(self.suffix)] if self.suffix and s.endswith(self.suffix) else s
            if self.suffix and body is s or not all(c in back for c in body):
                continue
            data = bytes(back[c] for c in body)
            if data and self.encode_bytes(data) == [i]:
                kept.append(data)
        return frozenset(kept)


@lru_cache(4)
def load(path: str) -> Bpe:
    """One parsed vocabulary per Python worker."""
    return Bpe(path)


# The split patterns that the two vocabulary files state.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Memo(dict):
    """A map from a string to ``make(string)`` that ages in two generations.

    ``turn()``, called between documents, starts a new generation once the young
    one is full; an entry of the old generation that is used again moves over.
    Memory is bounded by two generations whatever the corpus holds.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


#: Characters that some library takes for white space, beside space and line feed.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Punctuation that the byte-level pattern keeps in one run.
_TAIL = ".,;:!?|#*$%&()<>=\"-"


def separable(piece: str, special) -> bool:
    """Whether a piece between two single spaces can be encoded alone, as a space and itself.

    In the byte-level pattern a space followed by a non-space always begins a
    pre-token, and what precedes it ends there.  That holds for a piece that is
    not empty, neither begins nor ends with white space, and holds no special
    string; a text with any other piece is encoded as a whole.
    """
    return bool(piece) and piece[0] != "\n" and piece[-1] != "\n" and not _ODD.search(piece) and not any(s in piece for s in special)


def word_and_tail(piece: str) -> tuple[str, str] | None:
    """A piece as letters and a run of punctuation (two pre-tokens, the second maybe empty), or None.

    Only letters below U+0250 count here: all libraries agree on their class.
    """
    word = piece.rstrip(_TAIL)
    if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
        return word, piece[len(word) :]
    return None


def word_level_pretokens(text: str) -> list[str]:
    """Pre-tokens of the word-end vocabulary: composed, white space joined, lower case, split, white space dropped.

    Lower-casing is character by character, without regard to neighbours.
    """
    text = unicodedata.normalize("NFC", text)
    text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
    return WORD_LEVEL.findall(text)
