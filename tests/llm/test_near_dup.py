import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_odd import ODD, rows_of

from argentum.llm import bag_minhash as bm
from argentum.llm import near_dup as nd


def classes(rows):
    """Brute force: components of all pairs whose five-word windows overlap by 0.8 or more."""
    bags = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if w and i is not None:
            bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            s = sum((bags[a] & bags[b]).values())
            if s >= 0.8 * (bags[a].total() + bags[b].total() - s):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {i: find(i) for i in parent}


def copies(seed=0, families=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "an", "er", "in", "re", "on"]) for _ in range(rng.randrange(1, 5)))
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for f in range(families):
        base = [word() for _ in range(rng.randrange(3, 200))]
        if f % 3 == 0:
            base = base[:50] + passage
        current = list(base)
        for c in range(rng.choice([1, 1, 2, 6, 40 if f == 4 else 1])):
            if c % 2:
                current = list(base)  # else a chain: every copy is made from the one before
            for _ in range(c and rng.randrange(0, 1 + len(base) // 50)):
                current[rng.randrange(len(current))] = word()
            rows.append((i, " ".join(current)))
            i += 1
    rng.shuffle(rows)
    return rows


def got(df):
    return {r.doc_id: r.class_id for r in df.collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_classes_equal_brute_force(make, seed):
    rows = copies(seed)
    assert got(nd.near_duplicates(make(rows))) == classes(rows)


def test_a_bucket_full_of_chains(make, monkeypatch):
    """Members that only link through each other, searched in small blocks."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(7)
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(40):
        for k in range(15):
            text[(i * 15 + k) % 400] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    assert got(nd.near_duplicates(make(rows))) == classes(rows)


def test_odd_rows(make, odd):
    out = rows_of(nd.near_duplicates(odd), "doc_id", "class_id")
    want = classes(ODD)
    assert out == sorted([(i, want.get(i)) for i, _ in ODD], key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    assert nd.near_duplicates(odd.limit(0)).collect() == []


def test_one_of_each_class_stays(make, odd):
    kept = nd.drop_near_duplicates(odd)
    assert sorted(kept.columns) == sorted(odd.columns)
    assert rows_of(kept, "doc_id") == sorted([(1,), (2,), (3,), (4,), (5,), (6,), (7,), (8,), (9,), (10,), (11,), (13,), (14,), (15,), (None,)], key=lambda r: (r[0] is None, r[0] or 0))
    twins = make([(5, "one two three four five six"), (5, "one two three four five six"), (6, "other words altogether in this text"), (None, "one two three four five six")])
    assert rows_of(nd.drop_near_duplicates(twins), "doc_id") == [(5,), (6,), (None,)]


@pytest.mark.parametrize("heaviest", [1, 4, 60])
def test_signatures_are_unbiased(heaviest):
    rng = np.random.default_rng(heaviest)
    h = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = (h[:300], rng.integers(1, heaviest + 1, 300)), (h[80:], rng.integers(1, heaviest + 1, 320))
    n = 4000
    s = bm.signatures([a, b], n)
    want = bm.overlap(a, b)
    assert abs((s[0] == s[1]).mean() - want) < 5 * (want * (1 - want) / n) ** 0.5


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    bags = [(np.sort(rng.integers(0, 2**63, k).astype(np.uint64)), rng.integers(1, 5, k)) for k in (1, 2, 30, 500)]
    together = bm.signatures(bags, 252)
    assert all((bm.signatures([b], 252)[0] == t).all() for b, t in zip(bags, together))


def kept_by_brute_force(rows):
    """Rows with an id that are the first (by id, then by the text's hash as given) of their text's class."""
    bags = {}
    for i, t, h in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bags[i, h] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    names = sorted(bags)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(names):
        for b in names[:n]:
            s = sum((bags[a] & bags[b]).values())
            if s >= 0.8 * (bags[a].total() + bags[b].total() - s):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {n: find(n) for n in names}


def test_one_id_with_several_texts(spark, make):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows = []
    for f in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(4):  # ids from a small range clash between the families
            near = list(base)
            near[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            rows.append((rng.randrange(10), " ".join(near)))
    a, b = ([f"{c}{k}" for k in range(300)] for c in "ab")
    rows += [(101, " ".join(a)), (101, " ".join(b)), (102, " ".join([*a[:-1], "z"])), (103, " ".join([*b[:-1], "z"])), (101, " ".join(a))]
    docs = make(rows)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    root = kept_by_brute_force([(i, t, hashes[t]) for i, t in rows])
    got = rows_of(nd.near_duplicates(docs), "doc_id", "class_id")
    assert got == sorted((i, root[i, hashes[t]][0]) for i, t in rows)
    assert (103, 101) in got and (102, 101) in got
    kept = nd.drop_near_duplicates(docs)
    assert rows_of(kept, "doc_id", "text") == sorted({(i, t) for i, t in rows if root[i, hashes[t]] == (i, hashes[t])})
    assert rows_of(kept.where("doc_id > 100"), "doc_id") == [(101,), (101,)]


def test_repeated_rows_with_other_columns_leave_one(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(5, text, {"a": str(k)}, k) for k in range(50)] + [(6, None, {}, 0), (6, None, {}, 0)], "doc_id bigint, text string, extra map<string,string>, n int").repartition(4)
    kept = nd.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    one = rows_of(kept, "doc_id", "n")
    assert [r[0] for r in one] == [5, 6]
    assert rows_of(nd.drop_near_duplicates(docs.repartition(7)), "doc_id", "n") == one
