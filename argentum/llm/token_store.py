"""Operator 2: a token-id store in ascending document order, compressed by Re-Pair.

The store is a Parquet table of containers (see ``repair``), one per shard of
about ``shard_ids`` ids, written by Spark's own writers, so it can live in any
store that Spark reaches and a lost task leaves nothing behind.

Null text counts as empty: its document is the end id alone.  Null document ids
come first in the order.  Repeated rows are stored as often as they occur; among
equal ids the text's hash decides the order.  Other columns are ignored.  A text
of any length is one document of one shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argentum.storage import scratch_dir, table, write_table

from . import repair
from .common import BYTE_BPE, claim, text_or_empty, vocabulary
from .library_ids import library_ids

#: At most so many shards are joined by broadcast (24 bytes each); more of them by a shuffle.
BROADCAST_SHARDS = 500_000


def _shards(batches, path: str, vocab: int, shard_ids: int):
    """Containers of the documents of one partition, in order."""
    dtype = "<u2" if vocab + 1 < 60_000 else "<u4"
    end = np.array([vocab], dtype).tobytes()  # the separator, one above the vocabulary
    claim("library_ids")
    lib = library_ids(path, dtype)
    part, seq = TaskContext.get().partitionId(), 0
    held: list[bytes] = []
    keys: list = []
    counts: list[int] = []
    total = 0

    def flush():
        symbols, rules = repair.compress(np.frombuffer(b"".join(held), dtype), vocab + 1, vocab)
        null = np.array([k is None for k in keys])
        blob = repair.pack(symbols, rules, np.array([0 if k is None else k for k in keys], np.int64), null, np.array(counts, np.int64), vocab + 1)
        named = [k for k in keys if k is not None]
        return pa.record_batch([[part], [seq], [len(keys)], [total], [min(named, default=None)], [max(named, default=None)], [blob]], schema=_SHARDS)

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = lib.encode(text) + end
            lib.turn()
            held.append(ids)
            keys.append(key)
            counts.append(len(ids) // len(end))
            total += counts[-1]
            if total >= shard_ids:
                yield flush()
                held, keys, counts, total, seq = [], [], [], 0, seq + 1
    if keys:
        yield flush()


_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("blob", pa.binary())])


def write_store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shard_ids: int = 1 << 20, to: str | None = None) -> str:
    """Encode, order by key and write the store; returns its folder."""
    from .bpe import load

    vocab = len(load(path).vocab | load(path).special)
    rows = (
        docs.select(F.col(key).cast("bigint").alias(key), text_or_empty(text))
        .withColumn("tie", F.xxhash64(text))
        .repartitionByRange(key, "tie")
        .sortWithinPartitions(key, "tie")
        .select(key, text)
    )
    shards = rows.mapInArrow(lambda it: _shards(it, path, vocab, shard_ids), "part int, seq int, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint, blob binary")
    if to is None:
        return write_table(shards, "token-store")
    shards.write.parquet(to)
    return to


def _digests(batches, end_id: int):
    for b in batches:
        for part, seq, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
            c = repair.Container(blob)
            ids = c.decode(end_id=end_id)
            stops = np.cumsum(c.counts.astype(np.int64))
            starts = stops - c.counts
            if len(ids) != c.n_ids:
                raise ValueError("a container's ids do not add up")
            view, n = memoryview(ids).cast("B"), len(c.keys)
            crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(starts.tolist(), stops.tolist())]
            yield pa.record_batch([
                pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, seq), pa.int32()), pa.array(c.keys, pa.int64(), mask=c.null.astype(bool)),
                pa.array(starts, pa.int64()), pa.array(c.counts.astype(np.int64)), pa.array(crc, pa.int64()),
            ], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])


def shard_starts(store: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each shard; summed within parts first, then over the parts."""
    shards = store.select("part", "seq", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return shards.select("part", "seq", own.alias("own")).join(parts, "part").select("part", "seq", (F.col("own") + F.col("before")).alias("base"))


def read_digests(spark: SparkSession, store_dir: str, end_id: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document."""
    store = spark.read.parquet(store_dir)
    bases = shard_starts(store)
    if store.count() <= BROADCAST_SHARDS:
        bases = F.broadcast(bases)
    rows = store.select("part", "seq", "blob").mapInArrow(lambda it: _digests(it, end_id), "part int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, store_dir: str, end_id: int = 0) -> DataFrame:
    """(doc_id, ids array<bigint>) of every stored document, end ids included."""

    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                c = repair.Container(blob)
                ids, stops = c.decode(end_id=end_id), np.cumsum(c.counts.astype(np.int64))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], stops]).astype(np.int32), pa.array(ids.astype(np.int64)))
                yield pa.record_batch([pa.array(c.keys, pa.int64(), mask=c.null.astype(bool)), lists], names=["doc_id", "ids"])

    return spark.read.parquet(store_dir).select("blob").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def read_slice(spark: SparkSession, store_dir: str, doc_id: int, first: int = 0, stop: int | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, ids array<bigint>): ids first .. stop - 1 of one document, once for each row with that id.

    Only shards whose key range holds the id are read, and of their grammar only the rules that these ids need.
    """

    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                c = repair.Container(blob)
                found = np.flatnonzero((c.keys == doc_id) & (c.null == 0)).tolist()
                ids = [c.slice(k, first, stop, end_id).astype(np.int64) for k in found]
                yield pa.record_batch([pa.array([doc_id] * len(found), pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    shards = spark.read.parquet(store_dir).where((F.col("first_key") <= doc_id) & (F.col("last_key") >= doc_id))
    return shards.select("blob").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    """Write the store, read it back."""
    scratch_dir(spark)
    return read_digests(spark, write_store(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE)))
