"""Pairs, numbers and places against plain versions."""

import random

import numpy as np
import pytest

from argentum.operators import clustering, duplicates, places, search, vectors
from argentum.operators.numbering import dealt, numbered


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def some_prints(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        out.append(base)
        for flips in (1, 4, 10, 11, 12):
            out.append(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    out = list(dict.fromkeys(out))
    return [x - 2**64 if x >> 63 else x for x in out]


@pytest.mark.parametrize("threshold", [0, 3, 10])
def test_print_pairs_equal_brute_force(spark, threshold):
    rows = [(p, f"/{i:04d}") for i, p in enumerate(some_prints())]
    rows += [(rows[3][0], "/9998"), (rows[3][0], "/9999")]
    got = {(r.u, r.v, r.bits) for r in duplicates.band_pairs(spark.createDataFrame(rows, "phash bigint, pos string"), threshold).collect()}
    want = {(u, v, bits(p, q)) for i, (p, u) in enumerate(rows) for q, v in rows[i + 1 :] if bits(p, q) <= threshold}
    assert got == want and (threshold == 0 or want)


def test_print_candidates_are_few(spark):
    rng = random.Random(4)
    n = 1000
    prints = spark.createDataFrame([(rng.getrandbits(63), str(i)) for i in range(n)], "phash bigint, pos string")
    asking, answering = duplicates.probes(prints)
    met = asking.join(answering, ["band", "part"]).where("p < q").count()
    assert asking.count() == 548 * n and met < 0.012 * n * (n - 1) / 2  # eleven bands of 5 or 6 bits met about a fifth


@pytest.mark.parametrize("block", [7, 2048])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(60, [1.0, 0.0]), (61, [1.0, 0.0]), (62, None), (None, [1.0, 0.0]), (63, [1.0, None])]
    got = {(r.u, r.v): r.distance for r in vectors.cosine_edges(spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3), 0.3, block=block).collect()}
    want = {(i, j): 1 - v[i] @ v[j] for i in range(60) for j in range(i + 1, 60) if 1 - v[i] @ v[j] <= 0.3} | {(60, 61): 0.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_numbers_in_order(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(1000), f"{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = {r.b: r.number for r in numbered(df, ["a", "b"], start=3).collect()}
    assert got == {b: n + 3 for n, (_, b) in enumerate(sorted(rows))}
    assert numbered(df.limit(0), ["a"]).collect() == []
    workers = {r.b: r.worker for r in dealt(df, ["b"], 4).collect()}
    assert workers == {b: n % 4 for n, b in enumerate(sorted(b for _, b in rows))}


def distances(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


@pytest.mark.parametrize(("n", "spread", "kept"), [(1, 1.0, 1 << 20), (2, 0.0, 1 << 20), (200, 1.5, 1 << 20), (200, 1.5, 1), (150, 8.0, 4000), (120, 0.05, 1 << 20)])
def test_places_equal_the_matrix(n, spread, kept):
    rng = np.random.default_rng(n)
    lat, lon = 48 + rng.normal(size=n) * spread, (179.9 + rng.normal(size=n) * spread + 180) % 360 - 180
    got = clustering.agglomerate_places(lat, lon, 50.0, kept)
    want = clustering.agglomerate(distances(lat, lon), 50.0)
    assert got.tolist() == want.tolist()


def test_many_places_in_one_component():
    rng = np.random.default_rng(1)
    lat, lon = 48 + np.cumsum(rng.normal(size=4000)) * 0.01, 2 + np.cumsum(rng.normal(size=4000)) * 0.01
    owner = clustering.agglomerate_places(lat, lon, 20.0, 8 << 20)
    assert owner.tolist() == clustering.agglomerate(distances(lat, lon), 20.0).tolist()


def test_places_in_spark(spark):
    rng = random.Random(9)
    rows = [(i, 48 + rng.gauss(0, 1), 2 + rng.gauss(0, 1)) for i in range(80)]
    got = {r.id: r.cluster for r in places.cluster_by_distance(spark.createDataFrame(rows, "id bigint, lat double, lon double"), 40.0).collect()}
    owner = clustering.agglomerate(distances(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])), 40.0)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == c) for c in set(m.values()))
    assert groups(got) == groups(dict(enumerate(owner.tolist())))


def test_sort_specs():
    assert search.parse_sort(" Date : ASC , size") == [("date", False), ("size", True)] and search.parse_sort("distance") == [("distance", False)]
    for bad in ("", "date,", "date,date", "speed", "date:up", "date:", "date asc", ":asc"):
        with pytest.raises(ValueError, match="relevance, distance, date, size"):
            search.parse_sort(bad)


def test_losers_and_kept_files(spark):
    rng = random.Random(2)
    rows = [(f"/{i}", f"h{rng.randrange(20)}", 5, rng.choice([None, "2020-01-01T00:00:00", "2019-01-01T00:00:00", "0000-00-00T00:00:00"]), "2021-01-01T00:00:00", rng.choice([None, "2018-01-01T00:00:00"])) for i in range(90)] + [("/alone", "x", 5, None, None, None)]
    files = spark.createDataFrame(rows, "path string, hash string, size_bytes bigint, exif_date string, modified_at string, created_at string").repartition(4)
    ranked = duplicates.duplicate_files(files).collect()
    assert sorted(r.path for r in duplicates.losers(files).collect()) == sorted(r.path for r in ranked if r.rn > 1)
    kept = search.keep_one_by_best_date(files)
    assert kept.columns == [*files.columns, "best_date"]
    assert {r.hash: r.path for r in kept.collect()} == {r.hash: r.path for r in ranked if r.rn == 1} | {r[1]: r[0] for r in rows if sum(x[1] == r[1] for x in rows) == 1}
