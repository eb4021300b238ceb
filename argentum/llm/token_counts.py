"""Operator 1: token counts by the whole-token shortcut.

Most pre-tokens of a corpus are vocabulary strings.  ``Bpe.whole_tokens`` proves
once, offline, which of them encode alone as one token; such a pre-token counts
1 with no merge at all, and only the rest goes through the merge queue.

Null text counts as empty; an empty text has 0 bytes and 0 tokens.  A null
document id stays null.  Repeated rows give repeated results.  Other columns of
the input are ignored.  Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import BYTE_BPE, cache_of, claim, text_or_empty, vocabulary


class Counter:
    """Counts tokens of whole texts for a byte-level vocabulary."""

    def __init__(self, path: str):
        self.bpe = bpe.load(path)
        self.whole = self.bpe.whole_tokens()
        self.pretokens = bpe.Memo(self._pretoken, 200_000)
        self.pieces = bpe.Memo(self._piece, 200_000)
        self.special = tuple(self.bpe.special)
        self.cut = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def _pretoken(self, s: str) -> int:
        data = s.encode()
        return 1 if data in self.whole else len(self.bpe.encode_bytes(data))

    def _piece(self, piece: str) -> int | None:
        if not bpe.separable(piece, self.special):
            return None
        if parts := bpe.word_and_tail(piece):
            word, tail = parts
            return self.pretokens[" " + word] + (self.pretokens[tail] if tail else 0)
        return sum(self.pretokens[p] for p in bpe.BYTE_LEVEL.findall(" " + piece))

    def whole_text(self, text: str) -> int:
        """By the split pattern over the uncut text; special strings are one token each."""
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self.pretokens[p] for x in parts for p in bpe.BYTE_LEVEL.findall(x))

    def count(self, text: str) -> int:
        first, *rest = text.split(" ")
        if rest:
            last = rest.pop()
            try:
                n = sum(map(self.pieces.__getitem__, rest))
            except TypeError:  # a piece that can't be cut out
                return self.whole_text(text)
            if first and last and first[-1] != "\n" and last[0] != "\n" and not bpe._ODD.search(first) and not bpe._ODD.search(last):
                return n + self.whole_text(first) + self.whole_text(" " + last)
        return self.whole_text(text)

    def turn(self) -> None:
        self.pieces.turn()
        self.pretokens.turn()


@cache_of("token_counts")
@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches):
        claim("token_counts")
        c = counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = []
            for t in texts:
                n.append(c.count(t))
                c.turn()
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text_or_empty(text)).selectExpr(key, text, f"cast(octet_length({text}) as bigint) n_bytes")
    return rows.mapInArrow(run, f"{key} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    from argentum.storage import table

    return token_counts(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))
