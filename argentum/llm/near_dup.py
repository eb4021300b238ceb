"""Operator 4: near-duplicate documents by weighted MinHash, banding and verified overlap.

A document is the multiset of its five-word windows; two documents are linked if
their multisets' weighted Jaccard similarity is 0.8 or more, and a class is a
connected component of links.  The steps:

1. Documents with the same words are one text from here on, told by a 128-bit
   digest of the words and named by a number of its own; ids come back at the end.
2. Every text gets a BagMinHash signature of 252 registers, cut into 36 bands of
   7.  Two texts at the threshold share a band with probability 0.9998.
3. In each band bucket the smallest number stands as centre; every other member is
   verified against it by exact multiset overlap.  So a bucket of n copies costs
   n - 1 pairs.
4. Components of the verified links.  Buckets whose members still lie in several
   components are searched whole: members outside the bucket's largest component
   meet all its members from other components, in a grid of blocks of bounded
   size on both sides; pairs that are likely by signature (which misses a link
   with a chance below 1e-6) are verified exactly where they meet, so only links
   leave the task, never candidates.
5. Components again, over all links.

No pair that shares a bucket is left out, whatever the bucket's size.

Words are runs of anything but space and U+0009 to U+000D.  A document of one to
four words is one window.  Null texts and texts without words are like no other:
each is its own class.  A class is named by its smallest id.  A null id stays
null; its class is its text's, or null where no document of the class has an id.
Rows that share an id but not the text are documents of their own: each is in its
own text's class.  Within an id, texts are told apart by a 64-bit hash.  Repeated
rows give repeated results.  Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.operators.components import components
from argentum.storage import materialize, table

from . import bpe
from .bag_minhash import mix, overlap, signatures
from .common import cache_of, claim

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
#: Least share of equal registers at which a pair is verified: five standard errors below the threshold.
LIKELY = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Signatures are made for so many windows at a time; pairs are verified, and buckets searched on both sides, in groups of so many texts.
BATCH_WINDOWS, GROUP, BLOCK = 150_000, 256, 256
#: Up to so many ids (with a hash and a number, 24 bytes) are joined to the documents by broadcast; more by a shuffle.
BROADCAST_IDS = 500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@cache_of("near_dup")
@lru_cache(1)
def _word_hashes() -> bpe.Memo:
    return bpe.Memo(xxhash.xxh64_intdigest, 150_000)


def bag(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct window hashes, how often each occurs)."""
    memo = _word_hashes()
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    memo.turn()
    k = min(WORDS, len(words))
    h = w[: len(w) - k + 1]
    for i in range(1, k):
        h = h * _FACTOR + w[i : len(w) - k + 1 + i]
    s = np.sort(mix(h + np.uint64(k)))
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sign(batches):
    """Digest, band keys and the registers' low bytes of every document; nulls for one without words."""
    claim("near_dup")
    for b in batches:
        held: list = []
        size = 0
        for i, t, h in zip(*(c.to_pylist() for c in b.columns)):
            w = _words(t)
            held.append((i, h, xxhash.xxh3_128_digest(b" ".join(w)) if w else None, bag(w) if w else None))
            size += len(w)
            if size >= BATCH_WINDOWS:
                yield _signed(held)
                held, size = [], 0
        if held:
            yield _signed(held)


def _signed(held: list) -> pa.RecordBatch:
    full = [k for k, h in enumerate(held) if h[3] is not None]
    bands: list = [None] * len(held)
    sig: list = [None] * len(held)
    # multisets of about the same size end their processes at about the same time
    full.sort(key=lambda k: len(held[k][3][0]))
    for at in range(0, len(full), 256):
        some = full[at : at + 256]
        times = mix(signatures([held[k][3] for k in some], REGISTERS).view(np.uint64))
        low = (times & np.uint64(0xFF)).astype(np.uint8)
        keys = np.arange(BANDS, dtype=np.uint64) * _FACTOR
        for r in range(ROWS):
            keys = mix(keys + times[:, r::ROWS][:, :BANDS])
        keys = keys.view(np.int64)
        for j, k in enumerate(some):
            bands[k], sig[k] = keys[j], low[j].tobytes()
    return pa.record_batch([*(pa.array([h[i] for h in held], _SIGNED.field(i).type) for i in range(3)), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], schema=_SIGNED)


def _hash(text: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hash, digest, bands, sig) of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), _hash(text).alias("hash"))
    return rows.mapInArrow(_sign, "doc_id bigint, hash bigint, digest binary, bands array<bigint>, sig binary")


def _verify(batches):
    """Of rows sorted by (centre, part, member first null): pairs whose overlap reaches the threshold."""
    centre, own = None, None
    for b in batches:
        u, v = [], []
        for a, part, member, text in zip(*(c.to_pylist() for c in b.columns)):
            if member is None:
                centre, own = (a, part), bag(_words(text))
            elif own is not None and centre == (a, part) and overlap(own, bag(_words(text))) >= SIMILARITY:
                u.append(a)
                v.append(member)
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (u, v) whose texts overlap enough; u's text goes once to each group of its partners."""
    sizes = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("parts"))
    sizes = materialize(sizes, "centres")
    parted = pairs.join(sizes, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    centres = sizes.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = materialize(centres.select(F.col("u").alias("rep"), "u", "part", F.lit(None).cast("bigint").alias("v")).union(parted.select(F.col("v").alias("rep"), "u", "part", "v")), "wanted")
    texts = _texts(docs, wanted.select("rep").distinct(), reps, key, text)
    rows = wanted.join(texts, "rep").select("u", "part", "v", "text")
    return rows.repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v")).mapInArrow(_verify, "u bigint, v bigint")


class _Block:
    """Members of a bucket that search it for links out of their components."""

    def __init__(self, at):
        self.at = at
        self.ids = self.comps = np.zeros(0, np.int64)
        self.sigs = np.zeros((0, REGISTERS), np.uint8)
        self.bags: list = []
        self.joined: dict[int, int] = {}

    def add(self, ids, comps, sigs, bags) -> None:
        self.ids, self.comps, self.sigs = (np.concatenate(x) for x in ((self.ids, ids), (self.comps, comps), (self.sigs, sigs)))
        self.bags += [_unpack(b) for b in bags]

    def component(self, c: int) -> int:
        while c in self.joined:
            c = self.joined[c]
        return c

    def meet(self, ids, comps, searching, sigs, bags):
        """Links to members of other components; of two searching members the one with the smaller id looks."""
        for x in range(0, len(ids), 64):
            part = slice(x, x + 64)
            alike = (self.sigs[:, None, :] == sigs[None, part]).sum(2, dtype=np.uint16) / REGISTERS
            alike = (alike - 1 / 256) * (256 / 255)
            looks = ~searching[None, part] | (self.ids[:, None] < ids[None, part])
            i, j = np.nonzero((alike >= LIKELY) & looks & (self.comps[:, None] != comps[None, part]))
            held: dict = {}
            for k in np.argsort(-alike[i, j], kind="stable").tolist():
                mine, other = int(i[k]), x + int(j[k])
                a, b = self.component(int(self.comps[mine])), self.component(int(comps[other]))
                if a == b:
                    continue
                if other not in held:
                    held[other] = _unpack(bags[other])
                if overlap(self.bags[mine], held[other]) >= SIMILARITY:
                    self.joined[max(a, b)] = min(a, b)
                    yield int(self.ids[mine]), int(ids[other])


def _pack(b: tuple[np.ndarray, np.ndarray]) -> bytes:
    return b[0].astype("<u8").tobytes() + b[1].astype("<u4").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)


def _bags(batches):
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([_pack(bag(_words(t))) for t in b.column(1).to_pylist()], pa.binary())], names=["rep", "bag"])


def _search(batches):
    """Of rows sorted by (bucket, cell, role): verified links between members of different components."""
    block = None
    for b in batches:
        key, cell, role, rep, comp = (b.column(i).to_numpy() for i in range(5))
        searching = b.column(5).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(len(key), REGISTERS)
        bags = b.column(7).to_pylist()
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (role[1:] != role[:-1])]))
        links: list = []
        for s, e in zip(edge, [*edge[1:], len(key)]):
            if block is None or block.at != (key[s], cell[s]):
                block = _Block((key[s], cell[s]))
            if role[s]:
                links += block.meet(rep[s:e], comp[s:e], searching[s:e], sig[s:e], bags[s:e])
            else:
                block.add(rep[s:e], comp[s:e], sig[s:e], bags[s:e])
        yield pa.record_batch([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["u", "v"])


def _texts(docs: DataFrame, wanted: DataFrame, reps: DataFrame, key: str, text: str) -> DataFrame:
    """(rep, text) of the wanted texts, each from the documents that ``reps`` names for it."""
    wanted = materialize(wanted.join(reps.select("rep", "at"), "rep").select("rep", F.col("at.doc_id").alias("at_id"), F.col("at.hash").alias("at_hash")), "wanted-texts")
    rows = docs.select(F.col(key).cast("bigint").alias("id"), _hash(text).alias("hash"), F.col(text).alias("text"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = rows.join(wanted, F.col("hash").eqNullSafe(F.col("at_hash")) & F.col("id").eqNullSafe(F.col("at_id")))
    return materialize(found.groupBy("rep").agg(F.min("text").alias("text")), "texts")


def _between_components(docs: DataFrame, buckets: DataFrame, reps: DataFrame, comps: DataFrame, key: str, text: str) -> DataFrame:
    """Verified links (u, v) between texts of one bucket that are still in different components."""
    members = materialize(buckets.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("comp")), "members")
    open_ = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("key")
    members = materialize(members.join(materialize(open_, "open"), "key", "left_semi"), "open-members")
    # a bucket's largest component; its members need no comparing among themselves
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / BLOCK).alias("lines"), F.ceil(F.sum("n") / BLOCK).alias("columns"))
    main = materialize(main, "main")
    bags = _texts(docs, members.select("rep").distinct(), reps, key, text).mapInArrow(_bags, "rep bigint, bag binary")
    signed = materialize(reps.select("rep", "sig").join(bags, "rep"), "open-texts")
    rows = members.join(main, "key").join(signed, "rep").withColumn("searching", F.col("comp") != F.col("main"))
    # a cell of the grid: one block of searching members, one block of all members
    line, column = (F.pmod(F.xxhash64("rep"), F.col(c)) for c in ("lines", "columns"))
    others = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    shown = ["rep", "comp", "searching", "sig", "bag"]
    firsts = rows.where("searching").withColumn("line", line).withColumn("column", others("columns")).withColumn("role", F.lit(0))
    seconds = rows.withColumn("column", column).withColumn("line", others("lines")).withColumn("role", F.lit(1))
    cell = (F.col("line") * F.col("columns") + F.col("column")).alias("cell")
    grid = firsts.select("key", cell, "role", *shown).union(seconds.select("key", cell, "role", *shown))
    found = grid.repartition("key", "cell").sortWithinPartitions("key", "cell", "role").mapInArrow(_search, "u bigint, v bigint")
    return found.distinct()


def _classified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, hash, digest, class_id, class_hash) of every row.

    ``class_id`` and ``class_hash`` name the document that stands for the class:
    the one with the smallest id, and of several texts of that id the one with the
    smallest hash.
    """
    signed = materialize(sign(docs, key, text), "signed")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))
    reps = signed.where("digest is not null").groupBy("digest").agg(F.min(named).alias("first"), F.min("hash").alias("hash"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    at = F.coalesce("first", F.struct(F.lit(None).cast("bigint").alias("doc_id"), "hash"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "digest", "first", at.alias("at"), "bands", "sig"), "texts-signed")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    centres = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    centres = materialize(centres, "band-centres")
    buckets = materialize(banded.join(centres, "key"), "buckets")
    star = materialize(buckets.where("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v")).distinct(), "star")
    links = materialize(verified(docs, star, reps, key, text), "links")
    comps = components(links)
    more = materialize(_between_components(docs, buckets.select("key", "rep"), reps, comps, key, text), "more-links")
    if more.limit(1).count():
        comps = components(links.union(more))
    grouped = materialize(reps.select("rep", "digest", "first").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "first", F.coalesce("label", "rep").alias("comp")), "grouped")
    leaders = grouped.groupBy("comp").agg(F.min("first").alias("leader"))
    classes = materialize(grouped.join(leaders, "comp").select("digest", F.col("leader.doc_id").alias("class_id"), F.col("leader.hash").alias("class_hash")), "classes")
    return signed.select("doc_id", "hash", "digest").join(classes, "digest", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id) of every row; a class is named by its smallest id."""
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return _classified(docs, key, text).select(F.col("doc_id").alias(key), own.alias("class_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each class, the one that names it, with all their columns.

    Rows without an id can't be named and all stay.  A row goes only if its own
    text is in the class of the document that stays.  Of rows that repeat both id
    and text one stays: the one whose columns, as JSON, have the smallest hash.
    """
    found = materialize(_classified(docs, key, text).where("doc_id is not null"), "near-duplicates")
    lost = found.where("digest is not null and (doc_id <> class_id or hash <> class_hash)").select(F.col("doc_id").alias("_named_id"), F.col("hash").alias("_named_hash")).distinct()
    lost = materialize(lost, "lost")
    own = (F.col(key).cast("bigint") == F.col("_named_id")) & (_hash(text) == F.col("_named_hash"))
    kept = docs.join(F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost, own, "left_anti")
    again = found.groupBy("doc_id", "hash").count().where("count > 1").select(F.col("doc_id").alias("_named_id"), F.col("hash").alias("_named_hash"))
    if not again.limit(1).count():
        return kept
    again = materialize(again, "repeated-rows")
    whole = F.struct(*docs.columns)
    once = kept.join(again, own, "left_semi").groupBy(F.col(key).alias("_key"), _hash(text).alias("_hash")).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_row"))
    return once.select("_row.*").unionByName(kept.join(again, own, "left_anti"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
