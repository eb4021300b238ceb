import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_odd import ODD, rows_of

from argentum.llm import bpe, codec, library_ids, packing, repair, token_counts, token_store
from argentum.llm.common import BYTE_BPE, WORD_BPE, library, vocabulary

BYTE, WORD = vocabulary(BYTE_BPE), vocabulary(WORD_BPE)


def ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def random_texts(n=300):
    rng = random.Random(5)
    bits = ["the", "Thing", "ble,", "é", "İ", "'s", "don't", "12", "３", "<|endoftext|>", "\n", "\n\n", "  ", " ", "\t", "\x1c", " ", "#$", "a.b", "ÀB", "中", "😀", "é", " ", "x|y", "ſ", "\x85"]
    return ["".join(rng.choice(bits) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("text", [t for _, t in ODD if t is not None] + random_texts())
def test_every_encoder_agrees_with_the_library(text):
    assert token_counts.counter(BYTE).count(text) == len(ids(BYTE, text))
    want = ids(WORD, text)
    n, said, decoded = codec.word_codec(WORD).digest(text)
    assert (n, said) == (len(want), " ".join(map(str, want)))
    assert decoded == library(WORD).decode(want, skip_special_tokens=False)
    assert codec.word_codec(WORD).encode_whole(text) == want
    for path, kind in ((BYTE, "<u2"), (WORD, "<u4")):
        assert np.frombuffer(library_ids.library_ids(path, kind).encode(text), kind).tolist() == ids(path, text)


def test_whole_tokens_are_those_that_encode_alone():
    b = bpe.load(BYTE)
    whole = b.whole_tokens()
    some = random.Random(1).sample(sorted(whole), 200)
    assert all(len(b.encode_bytes(x)) == 1 for x in some)


def test_merge_queue_equals_rescanning():
    b = bpe.load(WORD)

    def slow(s):
        while True:
            best = min(((b.merges[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in b.merges), default=None)
            if best is None:
                return s
            i = best[1]
            s = s[:i] + [b.merges[s[i], s[i + 1]][1]] + s[i + 2 :]

    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("thandinger") for _ in range(rng.randrange(1, 30))).encode()
        assert b.encode_bytes(word) == slow(b.symbols(word))


def test_memo_keeps_answers_over_generations():
    calls = []
    m = bpe.Memo(lambda k: calls.append(k) or k * 2, 3)
    for k in [1, 2, 3, 4, 1, 5, 6, 7, 8, 1]:
        assert m[k] == 2 * k
        m.turn()
    assert len(m) <= 4 and len(m.old) <= 4


def test_token_counts(odd):
    got = rows_of(token_counts.token_counts(odd, BYTE, limit=10), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), len(ids(BYTE, t)), len(ids(BYTE, t)) > 10) for i, t in ODD]
    assert got == sorted(want, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    assert token_counts.token_counts(odd.limit(0), BYTE).collect() == []


def test_round_trip_digests(odd):
    got = rows_of(codec.round_trip_digests(odd, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids(WORD, t)), sha(" ".join(map(str, ids(WORD, t)))), sha(library(WORD).decode(ids(WORD, t), skip_special_tokens=False))) for i, t in ODD]
    assert got == sorted(want, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    whole = codec.decode(codec.encode(odd, WORD), WORD)
    assert rows_of(whole, "doc_id", "text")[0] == (1, library(WORD).decode(ids(WORD, ODD[0][1]), skip_special_tokens=False))
    assert codec.round_trip_digests(odd.limit(0), WORD).collect() == []


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_grammar_round_trip(dtype):
    rng = np.random.default_rng(3)
    docs = [np.repeat(rng.integers(0, 40, 50), 3)[: rng.integers(0, 150)] for _ in range(200)] + [np.zeros(500, int), np.tile([1, 2, 3, 4], 200)]
    sep, first = 40, 41
    flat = np.concatenate([np.append(d, sep) for d in docs]).astype(dtype)
    symbols, rules = repair.compress(flat, first, sep)
    assert len(symbols) < len(flat) / 2 and len(rules)
    counts = np.array([len(d) + 1 for d in docs])
    c = repair.Container(repair.pack(symbols, rules, np.arange(len(docs)), np.zeros(len(docs), bool), counts, first))
    assert c.decode(end_id=7).tolist() == np.where(flat == sep, 7, flat).tolist()
    for k in (0, 5, len(docs) - 2, len(docs) - 1):
        assert c.document(k, 7).tolist() == [*docs[k].tolist(), 7]
    used = []
    c._part, part = lambda s, i, j, out: used.append(s) or part(s, i, j, out), c._part
    draw = random.Random(4)
    for k in [draw.randrange(len(docs)) for _ in range(60)] + [len(docs) - 2] * 10:
        i, j = sorted((draw.randrange(len(docs[k]) + 3), draw.randrange(len(docs[k]) + 3)))
        used.clear()
        assert c.slice(k, i, j, 7).tolist() == [*docs[k].tolist(), 7][i:j]
        assert len(used) <= j - i
    del c._part
    assert c.lengths.tolist() == [len(c.decode(np.array([first + k], c.symbols.dtype))) for k in range(len(rules))]
    with pytest.raises(ValueError):
        data = bytearray(repair.pack(symbols, rules, np.arange(len(docs)), np.zeros(len(docs), bool), counts, first))
        data[-1] ^= 1
        repair.Container(bytes(data))


def test_token_store(spark, odd):
    for shard in (1 << 20, 50):
        to = token_store.write_store(odd, BYTE, shard_ids=shard)
        got = token_store.read_digests(spark, to).collect()
        texts = {(i, zlib.crc32(np.array([*ids(BYTE, t), 0], "<u4").tobytes()), len(ids(BYTE, t)) + 1) for i, t in ODD}
        assert {(r.doc_id, r.ids_crc32, r.n_tokens) for r in got} == texts and len(got) == len(ODD)
        at = 0
        order = sorted(got, key=lambda r: r.start)
        for r in order:
            assert r.start == at
            at += r.n_tokens
        keys = [r.doc_id for r in order]
        assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
        back = {r.doc_id: r.ids for r in token_store.read_ids(spark, to).collect()}
        assert back[7] == [*ids(BYTE, ODD[6][1]), 0]
        for i, a, b in ((8, 2990, 3002), (7, 0, None), (3, 0, 5), (9, 100, 140)):
            got = [r.ids for r in token_store.read_slice(spark, to, i, a, b).collect()]
            assert got == [[*ids(BYTE, next(t for k, t in ODD if k == i)), 0][a:b]]
        assert token_store.read_slice(spark, to, 999).collect() == [] and len(token_store.read_slice(spark, to, 12).collect()) == 2
    empty = token_store.write_store(odd.limit(0), BYTE)
    assert token_store.read_digests(spark, empty).collect() == []


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(odd):
    got = packing.pack_documents(odd, WORD, 64).collect()
    want = {}
    for i, t in ODD:
        full = [*ids(WORD, t), 0]
        for p, at in enumerate(range(0, len(full), 64)):
            want.setdefault((i, p, at, len(full[at : at + 64]), zlib.crc32(np.array(full[at : at + 64], "<u4").tobytes())), []).append(1)
    assert sorted(map(str, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got])) == sorted(str(k) for k, v in want.items() for _ in v)
    n = check_packing(got, 64)
    assert n <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack_documents(odd.limit(0), WORD, 64).collect() == []


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(11, int)
    counts[[7, 2, 3]] = [1, 1, 0]
    assert packing.best_two_fit(counts, 10) == [([7, 2], 1)]
    counts = np.zeros(101, int)
    counts[[60, 35, 20, 19]] = 1  # 60 + 35 leaves 5; 20 + 19 fill the 40 better than 35 does
    assert packing.best_two_fit(counts, 100)[0] == ([60, 20, 19], 1)


def plainly(sizes, capacity):
    """Best-two-fit bin by bin over the documents themselves."""
    left, bins = sorted(sizes), []
    while left:
        own, gap = [], capacity
        while fits := [s for s in left if s <= gap]:
            own.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        small = min(own)
        pairs = [(a + b, -a, b) for n, a in enumerate(left) for b in left[n + 1 :] if small < a + b <= gap + small]
        if gap and pairs:
            _, a, b = max(pairs)
            own.remove(small)
            for s in (-a, b):
                own.append(s)
                left.remove(s)
            left = sorted([*left, small])
        bins.append(sorted(own, reverse=True))
    return bins


def test_best_two_fit_equals_a_plain_version():
    rng = np.random.default_rng(6)
    for n in (1, 5, 40, 150):
        for capacity in (10, 37, 100):
            sizes = np.minimum(capacity - 1, rng.integers(1, capacity, n) if n % 2 else rng.geometric(0.15, n))
            counts = np.bincount(sizes, minlength=capacity)
            assert [b for b, times in packing.best_two_fit(counts, capacity) for _ in range(times)] == plainly(sizes.tolist(), capacity)


def test_ranks_in_many_groups_fill_the_same_bins(spark):
    rng = np.random.default_rng(7)
    sizes = [10] * 7 + rng.integers(1, 10, 300).tolist()
    parts = spark.createDataFrame([(None if i % 50 == 0 else i, 0, 0, s, i % 3) for i, s in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(3)
    want = sum(times for _, times in packing.best_two_fit(np.bincount([s for s in sizes if s < 10], minlength=10), 10)) + 7
    for per_group in (3, 100_000):
        got = packing.best_fit_pack(packing.materialize(parts, "parts"), 10, per_group=per_group).collect()
        assert len(got) == len(sizes) and check_packing(got, 10) == want


def test_best_two_fit_uses_every_document_once():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = np.bincount(rng.integers(1, 65, rng.integers(1, 500)), minlength=65)
        used = np.zeros(65, int)
        n = 0
        for sizes, times in packing.best_two_fit(counts, 64):
            assert sum(sizes) <= 64
            n += times
            for s in sizes:
                used[s] += times
        assert used.tolist() == counts.tolist()
        assert n <= 1.1 * (counts * np.arange(65)).sum() / 64 + 8


def test_replacement_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 1000, 200_000)
    passage = rng.integers(0, 1000, 64)  # its last rounds remove under a hundredth of the symbols
    ids = np.concatenate([np.concatenate([passage, [1000], part]) for part in np.array_split(noise, 12)]).astype(np.uint16)
    symbols, rules = repair.compress(ids, 1001, 1000)
    pairs = np.stack([symbols[:-1], symbols[1:]], 1)
    pairs = pairs[(pairs != 1000).all(1)]
    distinct, counts = np.unique(pairs, axis=0, return_counts=True)
    assert len(rules) and counts[distinct[:, 0] != distinct[:, 1]].max() < 8
    assert repair.expansion_lengths(rules, 1001).max() >= 32
