"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
from functools import lru_cache

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file; the file stays where the host keeps it."""
    return public_tokenizers.path(name)


@lru_cache(4)
def library(path: str):
    """The tokenizers library's own object, one per Python worker, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Caches of this Python worker, by the operator that fills them.
_CACHES: dict = {}


def cache_of(operator: str):
    """Registers a cached function as belonging to an operator."""

    def add(f):
        _CACHES.setdefault(operator, []).append(f)
        return f

    return add


def claim(operator: str) -> None:
    """Empty the caches of all other operators: a reused worker keeps one operator's at a time."""
    others = [f for name, held in _CACHES.items() if name != operator for f in held if f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)
