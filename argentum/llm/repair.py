"""Re-Pair grammar compression of id sequences, and its random-access container.

A shard is a run of whole documents.  ``compress`` repeatedly counts all
neighbouring symbol pairs of the shard and replaces the frequent ones by new
nonterminals; each round replaces a batch of pairs, left to right where
occurrences overlap, so the count stays one vectorised sort.  A separator symbol
ends each document and never joins a pair, so every document is a run of whole
symbols and can be decoded alone.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

MAGIC = b"RPAIR002"
_HEAD = struct.Struct("<8sIIIQQQI")


def compress(symbols: np.ndarray, first: int, separator: int, batch: int = 4096, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k gives the two symbols of nonterminal ``first + k``.

    symbols: uint16 or uint32; ids below ``first`` are terminals.  A round takes up
    to ``batch`` pairs that occur ``least`` times or more; rounds go on until no pair
    does or the symbol type has no values left.  Only a pair with a new symbol can
    have become frequent since the last round, so a round looks at those alone; when
    none is left, one over all pairs finds what the batches left over, if they did.
    """
    wide, bits = (np.uint32, 16) if symbols.dtype == np.uint16 else (np.uint64, 32)
    low = wide((1 << bits) - 1)
    room = int(np.iinfo(symbols.dtype).max) - first + 1
    rules: list[np.ndarray] = []
    made, newest = 0, None  # the smallest symbol of the last round; none for a round over all pairs
    left_over = False  # whether a round since the last one over all pairs passed over a frequent pair
    slots = 18
    held, name = np.zeros(1 << slots, wide), np.zeros(1 << slots, symbols.dtype)
    while len(symbols) > 1 and made < room:
        if newest is None:
            code, at = symbols[:-1].astype(wide), None
            code <<= wide(bits)
            code |= symbols[1:]
        else:
            at = _beside(symbols, newest)
            code = symbols[at].astype(wide) << wide(bits) | symbols[at + 1]
        often = _frequent(code, separator, least, bits)
        pairs = often[: min(batch, room - made)]
        if not len(pairs):
            if newest is None or not left_over:
                break
            newest = None
            continue
        # a direct table from a pair's hash to its nonterminal; of pairs that collide the more frequent stays
        slot = _slot(pairs, slots, bits)
        _, keep = np.unique(slot, return_index=True)
        keep.sort()
        pairs, slot = pairs[keep], slot[keep]
        left_over = len(pairs) < len(often) or (left_over and newest is not None)
        held[0] = np.iinfo(wide).max
        held[slot] = pairs
        name[slot] = np.arange(first + made, first + made + len(pairs)).astype(symbols.dtype)
        of = _slot(code, slots, bits)
        found = np.flatnonzero(held[of] == code)
        put = name[of[found]]
        held[slot] = 0
        hits = found if at is None else at[found]
        # in a run of neighbouring hits every second one, from the first
        begins = np.flatnonzero(np.diff(hits, prepend=hits[0] - 2) != 1)
        into = np.arange(len(hits)) - np.repeat(begins, np.diff(np.append(begins, len(hits))))
        even = into % 2 == 0
        hits = hits[even]
        rules.append(np.stack([pairs >> wide(bits), pairs & low], 1).astype(symbols.dtype))
        newest = first + made
        made += len(pairs)
        symbols = _replaced(symbols, hits, put[even])
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), symbols.dtype)


def _replaced(symbols: np.ndarray, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Symbols with each pair that begins at ``at`` replaced by one symbol."""
    symbols = symbols.copy()
    symbols[at] = by
    if len(at) < 1000:  # whole stretches between a few places
        return np.concatenate([symbols[a:b] for a, b in zip([0, *(at + 2).tolist()], [*(at + 1).tolist(), len(symbols)])])
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return symbols[keep]


def _beside(symbols: np.ndarray, newest: int) -> np.ndarray:
    """Where a pair begins that holds a symbol from ``newest`` on."""
    new = symbols >= newest
    return np.flatnonzero(new[:-1] | new[1:])


def _frequent(code: np.ndarray, separator: int, least: int, bits: int) -> np.ndarray:
    """The pairs that occur ``least`` times or more, the most frequent first; none with the separator."""
    if not len(code):
        return code
    wide = code.dtype.type
    ordered = np.sort(code)
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), len(ordered) - 1)
    counts = np.diff(ends, prepend=-1)
    often = counts >= least
    pairs, counts = ordered[ends[often]], counts[often]
    inner = ((pairs >> wide(bits)) != separator) & ((pairs & wide((1 << bits) - 1)) != separator)
    pairs, counts = pairs[inner], counts[inner]
    return pairs[np.argsort(-counts, kind="stable")]


def _slot(code: np.ndarray, slots: int, bits: int) -> np.ndarray:
    if bits == 16:
        return (code * np.uint32(2654435761)) >> np.uint32(32 - slots)
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - slots)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of terminals that each nonterminal stands for; a rule only names earlier symbols."""
    out = np.ones(first + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[first + k] = out[a] + out[b]
    return out[first:]


def pack(symbols: np.ndarray, rules: np.ndarray, keys: np.ndarray, null: np.ndarray, counts: np.ndarray, first: int) -> bytes:
    """A container: head, rules, expansion lengths, document keys, null flags, ids per document, first symbol of each document, symbols."""
    wide = symbols.dtype.itemsize
    starts = np.concatenate([[0], np.flatnonzero(symbols == first - 1) + 1])
    if len(starts) != len(keys) + 1:
        raise ValueError("not one separator to each document")
    body = b"".join([
        rules.astype(symbols.dtype).tobytes(),
        expansion_lengths(rules, first).astype("<u4").tobytes(),
        keys.astype("<i8").tobytes(),
        null.astype("u1").tobytes(),
        counts.astype("<u4").tobytes(),
        starts.astype("<u4").tobytes(),
        symbols.tobytes(),
    ])
    return _HEAD.pack(MAGIC, wide, first, len(rules), len(keys), len(symbols), int(counts.sum()), zlib.crc32(body)) + body


@lru_cache(2)
def _terminals(first: int) -> list[bytes]:
    """Each terminal's id as four bytes."""
    data = np.arange(first, dtype="<u4").tobytes()
    return [data[i : i + 4] for i in range(0, len(data), 4)]


class Container:
    """Reads a container; documents decode alone or all at once."""

    def __init__(self, data: bytes):
        magic, wide, self.first, n_rules, n_docs, n_symbols, self.n_ids, crc = _HEAD.unpack_from(data)
        if magic != MAGIC or zlib.crc32(memoryview(data)[_HEAD.size :]) != crc:
            raise ValueError("not a whole token container")
        kind = np.dtype(f"<u{wide}")
        at = _HEAD.size

        def take(dtype, n):
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.rules = take(kind, 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.keys, self.null, self.counts, self.starts = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("<u4", n_docs + 1)
        self.symbols = take(kind, n_symbols)
        self.separator = self.first - 1

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol's expansion, one after another, with starts and lengths."""
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
        spelled = _terminals(self.first).copy()
        for a, b in self.rules.tolist():
            spelled.append(spelled[a] + spelled[b])
        return np.frombuffer(b"".join(spelled), "<u4"), np.cumsum(sizes) - sizes, sizes

    def decode(self, symbols: np.ndarray | None = None, end_id: int = 0) -> np.ndarray:
        """All ids as little-endian uint32, the end id in place of each separator."""
        if not hasattr(self, "_tables"):
            self._tables = self._flat()
        flat, starts, sizes = self._tables
        symbols = self.symbols if symbols is None else symbols
        n = sizes[symbols]
        before = np.cumsum(n) - n
        out = flat[np.arange(int(n.sum())) + np.repeat(starts[symbols] - before, n)]
        out[out == self.separator] = end_id
        return out.astype("<u4", copy=False)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        rule = symbols.astype(np.int64) - self.first
        if not len(self.lengths):
            return np.ones(len(symbols), np.int64)
        return np.where(rule < 0, 1, self.lengths[np.maximum(rule, 0)]).astype(np.int64)

    def _part(self, symbol: int, i: int, j: int, out: list) -> None:
        """Ids i .. j - 1 of one symbol; a rule's side outside that range is passed over by its length."""
        todo = [(symbol, i, j)]
        while todo:
            s, i, j = todo.pop()
            if s < self.first:
                out.append(s)
                continue
            a, b = self.rules[s - self.first].tolist()
            n = 1 if a < self.first else int(self.lengths[a - self.first])
            if j > n:
                todo.append((b, max(0, i - n), j - n))
            if i < n:
                todo.append((a, i, min(j, n)))

    def slice(self, k: int, i: int = 0, j: int | None = None, end_id: int = 0) -> np.ndarray:
        """Ids i .. j - 1 of the k-th document, from its own symbols and the rules that these ids need."""
        n = int(self.counts[k])
        i, j = min(i, n), n if j is None else min(j, n)
        if i >= j:
            return np.zeros(0, "<u4")
        symbols = self.symbols[self.starts[k] : self.starts[k + 1]]
        stops = np.cumsum(self.sizes(symbols))
        x, y = int(np.searchsorted(stops, i, "right")), int(np.searchsorted(stops, j, "left"))
        out: list = []
        for p in range(x, y + 1):
            before = int(stops[p - 1]) if p else 0
            self._part(int(symbols[p]), max(0, i - before), min(int(stops[p]), j) - before, out)
        ids = np.array(out, "<u4")
        ids[ids == self.separator] = end_id
        return ids

    def document(self, k: int, end_id: int = 0) -> np.ndarray:
        """Ids of the k-th document alone, with its end id."""
        return self.slice(k, end_id=end_id)
