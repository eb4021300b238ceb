"""Vectors in blocks: tables whose rows hold a bounded number of vectors as one matrix.

Work on pairs of vectors is dealt out as pairs of blocks, a row each, so that one
job covers all pairs wherever the blocks lie, and neither side passes through the
driver.  A pair's cost is its matrix product; moving its two blocks is little
beside it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.storage import materialize


def matrices(batch, of_id: int = 0, of_vector: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each number of components in a batch of (id, array<double>) without nulls."""
    ids, v = batch.column(of_id).to_numpy(zero_copy_only=False), batch.column(of_vector)
    offsets = v.offsets.to_numpy().astype(np.int64)
    values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], values[offsets[rows][:, None] + np.arange(d)]


def _pack(batches, size: int, change: Callable | None):
    held: dict[int, list] = {}

    def block(d):
        parts = held.pop(d)
        ids, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for at in range(0, len(ids), size):
            part = m[at : at + size]
            data = pickle.dumps((ids[at : at + size], change(part) if change else part))
            yield pa.record_batch([pa.array([d], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([data], pa.binary())], names=["dim", "n", "data"])

    for b in batches:
        for ids, m in matrices(b):
            d = m.shape[1]
            held.setdefault(d, []).append((ids, m))
            if sum(len(p[0]) for p in held[d]) >= size:
                yield from block(d)
    for d in list(held):
        yield from block(d)


def blocked(rows: DataFrame, size: int, name: str, change: Callable | None = None) -> DataFrame:
    """(block, dim, n, data) from (id, v array<double>): a written table of blocks of up to ``size`` vectors.

    ``data`` is for ``opened``; ``change`` is applied to every matrix.  Vectors of
    different lengths are in different blocks.
    """
    packed = rows.select("id", "v").mapInArrow(lambda it: _pack(it, size, change), "dim int, n int, data binary")
    return materialize(packed.withColumn("block", F.monotonically_increasing_id()), name)


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a block."""
    return pickle.loads(data)


def spread(blocks: DataFrame) -> DataFrame:
    """The blocks in at least as many partitions as there are cores, where that many exist."""
    least = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(least, "block") if blocks.rdd.getNumPartitions() < least else blocks
