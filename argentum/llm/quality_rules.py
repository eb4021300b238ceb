"""Operator 5: quality rules by repetition coverage.

A text is rejected by base rules (too few words, too many words inside repeated
eight-word windows) or because duplicated n-grams or duplicated lines cover too
many of its characters.  N-grams of several lengths are found by rolling hashes
over word numbers in numpy: the hash of n words is the hash of n - 1 words times
a constant plus the next word.  Coverage counts every character once, however
many duplicated n-grams lie over it, the first occurrence left out.

Words are runs of anything but space and U+0009 to U+000D.  Null text has no
words.  Texts of any length are measured whole; a null document id stays null;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from argentum.storage import table

from .common import text_or_empty

#: Base rules: fewest words, window in words, largest percentage of words inside repeated windows.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Largest share of the words' characters inside duplicated n-grams, by n.
COVERAGE = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.25, 9: 0.24, 10: 0.23}
#: Largest share of characters inside lines that equal an earlier one, and of symbols among words.
LINE_COVERAGE, SYMBOLS_PER_WORD = 0.30, 0.10

_SYMBOLS = b"#*$%&|<>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes: which occur twice or more, and which equal an earlier one."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    later = np.zeros(len(h), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def _cover(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in one of the n-word windows that begin where ``starts`` is set."""
    edge = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(text: str) -> dict:
    """All measures of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # ASCII white space: space and 0x09 to 0x0D
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in lines:
        if line in seen:
            dup_lines += 1
            dup_line_chars += _word_chars(line)
        elif line and line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    chars = _word_chars(text)
    out = {"n_words": n, "word_chars": chars, "n_symbols": len(data) - len(data.translate(None, _SYMBOLS)), "n_dup_lines": dup_lines, "dup_line_chars": dup_line_chars, "n_repeat_words": 0}
    coverage = dict.fromkeys(COVERAGE, 0)
    if n > min(COVERAGE):
        numbers: dict[bytes, int] = {}
        fresh = count()
        ids = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(fresh)) for w in words), np.uint64, n)
        if len(numbers) < n:  # else no window can occur twice
            mixed = _mix(ids + np.uint64(1))
            sizes = None
            h = mixed
            for k in range(2, max([*COVERAGE, WINDOW]) + 1):
                if n < k:
                    break
                h = h[:-1] * _FACTOR + mixed[k - 1 :]
                if k not in COVERAGE and k != WINDOW:
                    continue
                ordered = np.sort(h)
                if not (ordered[1:] == ordered[:-1]).any():
                    break  # longer windows can't repeat either
                twice, later = _repeated(h)
                if k == WINDOW:
                    out["n_repeat_words"] = int(_cover(twice, k, n).sum())
                if k in COVERAGE:
                    if sizes is None:
                        sizes = np.fromiter(map(len, text_words(text, words)), np.int64, n)
                    coverage[k] = int(sizes[_cover(later, k, n)].sum())
    return out | {"coverage": coverage}


def text_words(text: str, words: list[bytes]) -> list:
    """Words whose lengths count code points."""
    return words if text.isascii() else [w.decode("utf-8", "surrogatepass") for w in words]


def _word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept) of a text's measures."""
    n = m["n_words"]
    base_failed = n < LEAST_WORDS or 100 * m["n_repeat_words"] > REPEAT_PERCENT * n
    if base_failed:
        return True, False
    chars = max(1, m["word_chars"])
    return False, (
        all(m["coverage"][k] <= most * chars for k, most in COVERAGE.items())
        and m["dup_line_chars"] <= LINE_COVERAGE * chars
        and m["n_symbols"] <= SYMBOLS_PER_WORD * n
    )


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_chars, dup_gram_chars) of every row."""

    def run(batches):
        for b in batches:
            got = [measure(t) for t in b.column(1).to_pylist()]
            flags = [verdict(m) for m in got]
            yield pa.record_batch([
                b.column(0), *(pa.array([m[f] for m in got], pa.int64()) for f in _FIELDS),
                pa.array([f[0] for f in flags], pa.bool_()), pa.array([f[1] for f in flags], pa.bool_()),
                pa.array([m["dup_line_chars"] for m in got], pa.int64()), pa.array([max(m["coverage"].values()) for m in got], pa.int64()),
            ], names=[key, *_FIELDS, "base_failed", "kept", "dup_line_chars", "dup_gram_chars"])

    kind = docs.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, " + ", ".join(f"{f} bigint" for f in _FIELDS) + ", base_failed boolean, kept boolean, dup_line_chars bigint, dup_gram_chars bigint"
    return docs.select(key, text_or_empty(text)).mapInArrow(run, ddl)


def keep_by_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes all rules, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([verdict(measure(t or ""))[1] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
