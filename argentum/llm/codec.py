"""Operator 3: BPE encoding and decoding with a merge queue over a linked symbol list.

``Bpe.merge`` does the work; this module applies it to whole texts with the
word-end vocabulary.  That vocabulary file names no decoder, so decoding joins
the vocabulary strings of the ids with one space, special ones included.

Null text counts as empty: no ids, an empty decoded text.  A null document id
stays null.  Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import WORD_BPE, cache_of, claim, text_or_empty, vocabulary


class WordCodec:
    """Encodes and decodes with a word-end vocabulary; also packs ids as bytes."""

    def __init__(self, path: str):
        self.bpe = bpe.load(path)
        self.pretokens = bpe.Memo(self._pretoken, 250_000)
        self.pieces = bpe.Memo(self._piece, 250_000)
        self.special = self.bpe.special
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")" if self.special else r"((?!))")

    def _pretoken(self, s: str) -> tuple[int, ...]:
        return tuple(self.bpe.encode_bytes(s.encode()))

    def _part(self, text: str) -> list[int]:
        return [i for p in bpe.word_level_pretokens(text) for i in self.pretokens[p]]

    def _piece(self, piece: str) -> tuple[str, str, int]:
        """Of a piece without spaces: ids and vocabulary strings, each followed by a space, and how many."""
        ids = self.encode_whole(piece)
        strings = self.bpe.strings
        return "".join(f"{i} " for i in ids), "".join(f"{strings[i]} " for i in ids), len(ids)

    def encode_whole(self, text: str) -> list[int]:
        """Ids of a text, special strings first, then the rest between them."""
        if any(s in text for s in self.special):
            return [i for x in self.cut.split(text) for i in ([self.special[x]] if x in self.special else self._part(x))]
        return self._part(text)

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids, joined by one space."""
        strings = self.bpe.strings
        return " ".join(strings[i] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the texts of the ids and of their decoding.

        A space ends every pre-token and composes with nothing, so a text is the
        sequence of its pieces between spaces, whatever else they hold.
        """
        got = list(map(self.pieces.__getitem__, text.split(" ")))
        ids, decoded = "".join([g[0] for g in got]), "".join([g[1] for g in got])
        return sum([g[2] for g in got]), ids[:-1], decoded[:-1]

    def turn(self) -> None:
        self.pieces.turn()
        self.pretokens.turn()


@cache_of("codec")
@lru_cache(2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row: the operator's own output."""

    def run(batches):
        claim("codec")
        c = word_codec(path)
        for b in batches:
            ids = []
            for t in b.column(1).to_pylist():
                ids.append(c.encode_whole(t))
                c.turn()
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of id arrays; null ids decode to an empty text."""

    def run(batches):
        claim("codec")
        c = word_codec(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, ids).mapInArrow(run, f"{key} {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, decode and digest in one pass."""

    def run(batches):
        claim("codec")
        c = word_codec(path)
        for b in batches:
            n, x, y = [], [], []
            for t in b.column(1).to_pylist():
                k, ids, decoded = c.digest(t)
                n.append(k)
                x.append(hashlib.sha256(ids.encode()).hexdigest())
                y.append(hashlib.sha256(decoded.encode()).hexdigest())
                c.turn()
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text)).mapInArrow(run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op3_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    from argentum.storage import table

    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))
