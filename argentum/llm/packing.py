"""Operator 6: best-two-fit packing of documents into sequences of a fixed length.

Packing depends on lengths alone, and there are at most ``capacity`` of them.  So
the corpus is reduced to a histogram of lengths, the driver packs the histogram,
and every document finds its place from its length and its rank among the
documents of that length.  Pieces of full length need no rank: each is a sequence
of its own.  The others are ranked in groups of about ``PER_GROUP``, as many as
their length's count asks for, and the ranks of a length's groups follow on each
other; so no task grows with the corpus, and the driver holds ``capacity`` numbers.  A bin is filled greedily, the longest document that
still fits first; then its smallest document gives way to the two unpacked
documents that fill the gap so made most tightly.  As long as no length runs
out, the next bin comes out the same, so a bin is planned once with the number
of its repetitions.

Null text counts as empty: the document is its end id alone.  Null document ids
are packed like others.  Repeated rows are packed as often as they occur.  Other
columns are ignored.  Only documents longer than ``capacity`` are cut.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.storage import materialize, table

from .common import WORD_BPE, claim, text_or_empty, vocabulary
from .library_ids import library_ids

#: Documents of one length are ranked in groups of about so many, so that a common length is not one task's work.
PER_GROUP = 1000


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document's ids with the end id, cut at ``capacity``."""

    def run(batches):
        claim("library_ids")
        lib = library_ids(path, "<u4")
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for b in batches:
            out: list = [[], [], [], [], []]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = lib.encode(t) + end
                lib.turn()
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(out, (k, i, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text)).mapInArrow(run, f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins for ``counts[length]`` documents of each length: (lengths of a bin, how many such bins)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    bins = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return bins
        use: Counter = Counter()
        gap = capacity
        while gap > 0:  # the longest that fits, as often as it fits
            k = int(np.searchsorted(have, gap, "right")) - 1
            while k >= 0 and left[have[k]] <= use[int(have[k])]:
                k -= 1
            if k < 0:
                break
            size = int(have[k])
            take = min(int(left[size]) - use[size], gap // size)
            use[size] += take
            gap -= size * take
        if gap and use:
            small = min(use)
            pair = _two(have, left, use, small, gap + small)
            if pair:
                use[small] -= 1
                use.update(pair)
                use += Counter()
        times = min(int(left[size]) // n for size, n in use.items())
        for size, n in use.items():
            left[size] -= n * times
        bins.append((sorted(use.elements(), reverse=True), times))


def _two(have: np.ndarray, left: np.ndarray, use: Counter, small: int, room: int) -> tuple[int, int] | None:
    """The two unpacked documents with the largest sum up to ``room``, if that is more than ``small``."""
    free = np.array([s for s in have[: int(np.searchsorted(have, room, "left"))].tolist() if left[s] > use[s]], np.int64)
    if not len(free):
        return None
    spare = np.array([left[s] - use[s] for s in free.tolist()])
    at = np.searchsorted(free, room - free, "right") - 1
    alone = (at >= 0) & (free[np.maximum(at, 0)] == free) & (spare < 2)
    at = at - alone  # a length cannot be its own partner when only one document has it
    sums = np.where(at >= 0, free + free[np.maximum(at, 0)], 0)
    best = int(np.argmax(sums))
    if sums[best] <= small:
        return None
    return int(free[best]), int(free[at[best]])


def places(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the rank ranges that go to one slot of one kind of bin.

    Columns: first rank, bins of the kind, first bin number, offset of the slot.
    Their number depends on the lengths there are, not on the documents: a kind of
    bin ends because a length no longer suffices for it, which can happen to a
    length at most capacity / length times.
    """
    out: dict[int, list] = {}
    ranks: Counter = Counter()
    first = 0
    for sizes, times in bins:
        offset = 0
        for size in sizes:
            out.setdefault(size, []).append((ranks[size], times, first, offset))
            ranks[size] += times
            offset += size
        first += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def best_fit_pack(parts: DataFrame, capacity: int, key: str = "doc_id", per_group: int = PER_GROUP) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``; ``parts`` is a written table, read four times.

    Full pieces have negative sequence ids, the packed ones count from 0.
    """
    spark = parts.sparkSession
    shown = [key, "piece", "start", "length", "ids_crc32"]
    full = parts.where(F.col("length") == capacity).select(*shown, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = parts.where(F.col("length") < capacity)
    counts = np.zeros(capacity, np.int64)
    for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r.n
    groups = F.get(F.array(*(F.lit(max(1, -(-int(n) // per_group))) for n in counts)), F.col("length").cast("int"))
    rows = rest.withColumn("rank_group", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), groups).cast("int"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("rank_group")) - F.col("n")
    before = materialize(rows.groupBy("length", "rank_group").agg(F.count("*").alias("n")).select("length", "rank_group", earlier.alias("before")), "ranks-before")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "rank_group").orderBy(key, "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "rank_group"]).select(*shown, (F.col("rank") + F.col("before")).alias("rank"))
    plan = spark.sparkContext.broadcast(places(best_two_fit(counts, capacity)))

    def place(batches):
        where = plan.value
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                mine, t = np.flatnonzero(size == s), where[int(s)]
                k = np.searchsorted(t[:, 0], rank[mine], "right") - 1
                seq[mine], off[mine] = t[k, 2] + rank[mine] - t[k, 0], t[k, 3]
            yield pa.record_batch([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=[*shown, "sequence_id", "offset"])

    kind = parts.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").union(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return best_fit_pack(materialize(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))
