"""Kernels against slow versions on seeded data."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from argentum.operators import clustering, places
from argentum.operators.components import components
from argentum.operators.duplicates import similar_groups


def slow_linkage(d, limit):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y), default=None)
        if best is None or best[0] > limit:
            break
        _, x, y = best
        groups[x] += groups.pop(y)
    return {i: min(g) for g in groups for i in g}


def unit(n, d, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_equals_rescanning(seed):
    v = unit(30, 4, seed)
    d = 1 - v @ v.T
    owner = clustering.agglomerate(d, 0.4)
    assert dict(enumerate(owner.tolist())) == slow_linkage(d, 0.4)


def test_linkage_by_component_equals_the_whole(spark):
    v = unit(80, 5, 11)
    df = spark.createDataFrame([(i + 5, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "id bigint, embedding array<double>")
    got = {r.id: r.cluster for r in clustering.average_linkage_cosine(df, 0.3).collect()}
    assert got == {i + 5: c + 5 for i, c in slow_linkage(1 - v @ v.T, 0.3).items()}


@pytest.mark.parametrize("seed", range(6))
def test_linkage_of_vectors_needs_no_matrix(seed):
    v = unit(60, 3 + seed, seed)
    v = np.concatenate([v, v[:7]])
    for limit in (0.1, 0.4, 0.8):
        assert dict(enumerate(clustering.agglomerate_vectors(v, limit).tolist())) == slow_linkage(1 - v @ v.T, limit)
    assert clustering.agglomerate_vectors(v[:0], 0.4).tolist() == []


@pytest.mark.parametrize("seed", range(3))
def test_nearest_equals_the_largest_product(seed):
    v = unit(700, 5, seed)
    v = np.concatenate([v, v[:40], v[:40] + 1e-9, np.repeat(v[:1] * 1e20, 60, 0)])  # more that single precision cannot tell apart than it hands on
    own = np.arange(len(v))
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    place, best = clustering.nearest(v, v, own)
    assert (place != own).all() and np.allclose(best, s.max(1), rtol=1e-12) and np.allclose(s[own, place], s.max(1), rtol=1e-12)
    assert clustering.nearest(v[:1], v[:1], own[:1])[0].tolist() == [-1]
    assert clustering.nearest(v[:2], v[:0], own[:2] - 5)[0].tolist() == [-1, -1]


def test_nearest_in_several_blocks(monkeypatch):
    v = unit(300, 6, 3)
    want = clustering.nearest(v, v, np.arange(300))
    monkeypatch.setattr(clustering, "BLOCK", 64)
    got = clustering.nearest(v, v, np.arange(300))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_known_neighbours_and_sizes_go_on_where_a_round_ended():
    v = unit(50, 4, 8)
    pairs = np.stack([v[0::2], v[1::2]], 1)
    mean, size = pairs.mean(1), np.full(25, 2.0)
    d = 1 - mean @ mean.T
    near = np.where(np.eye(25, dtype=bool), np.inf, d).argmin(1)
    near[::3] = -1
    plain = clustering.agglomerate_vectors(mean, 0.6, size).tolist()
    assert clustering.agglomerate_vectors(mean, 0.6, size, near, d[np.arange(25), near]).tolist() == plain
    assert clustering.agglomerate_vectors(np.repeat(mean, 2, 0), 0.6).tolist()[::2] == [2 * c for c in plain]


def test_rounds_over_executors_equal_one_task(spark):
    v = unit(400, 6, 21)
    v = np.concatenate([v, v[:50], v[:50]])  # copies
    ids = np.random.default_rng(2).permutation(len(v)) * 3
    odd = [(5000, [1.0, 0.0]), (5001, [0.99, math.sqrt(1 - 0.99**2)]), (5002, [float("nan")] * 6), (5003, [float("inf")] + [0.0] * 5), (5004, [None] * 6), (None, v[0].tolist()), (5005, [0.0] * 6)]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)] + odd, "id bigint, embedding array<double>").repartition(5)
    order = np.argsort(ids)
    owner = clustering.agglomerate(1 - v[order] @ v[order].T, 0.35)
    want = {int(ids[i]): int(ids[order[c]]) for i, c in zip(order, owner)} | {k: k for k in (5000, 5002, 5003, 5004, None, 5005)} | {5001: 5000}
    assert 5 < len(set(owner.tolist())) < 200
    for alone_pairs in (0, 1 << 30):
        got = clustering.average_linkage_cosine(df, 0.35, alone_pairs=alone_pairs).collect()
        assert len(got) == len(want) and {r.id: r.cluster for r in got} == want


def slow_merge(sums, sizes, similarity, veto):
    groups = [([i], s, n) for i, (s, n) in enumerate(zip(sums, sizes))]
    while True:
        pairs = [(-a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y and 1 - a[1] @ b[1] / (a[2] * b[2]) <= veto]
        if not pairs or -min(pairs)[0] < similarity:
            return {i: min(g) for g, _, _ in groups for i in g}
        _, x, y = min(pairs)
        b = groups.pop(y)
        groups[x] = (groups[x][0] + b[0], groups[x][1] + b[1], groups[x][2] + b[2])


@pytest.mark.parametrize("seed", range(4))
def test_centroid_merge_equals_rescanning(seed):
    sizes = np.random.default_rng(seed).integers(1, 6, 40)
    sums = unit(40, 4, seed) * sizes[:, None] * 0.8
    for similarity, veto in ((0.35, 0.79), (0.35, 0.95), (0.6, 0.5)):
        assert dict(enumerate(clustering.merge_centroids(sums, sizes, similarity, veto).tolist())) == slow_merge(sums, sizes, similarity, veto)


@pytest.mark.parametrize("similarity, veto", [(0.2, 0.95), (0.0, 1.2), (-1.0, 3.0)])
def test_centroid_merge_after_many_clusters_are_gone(similarity, veto):
    sizes = np.random.default_rng(5).integers(2, 9, 80)
    sums = unit(80, 6, 5) * sizes[:, None] * 0.7
    want = slow_merge(sums, sizes, similarity, veto)
    assert len(set(want.values())) < 40
    assert dict(enumerate(clustering.merge_centroids(sums, sizes, similarity, veto).tolist())) == want


def test_linkage_is_worked_out_once_for_the_centroid_merge(spark):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit(40, 3, 2))], "id bigint, embedding array<double>")
    linked = clustering.average_linkage_cosine(df, 0.3)
    assert spark.read.parquet(linked.written_to).count() == 40  # several plans read a table, not the linkage


def test_more_than_20000_members_and_clusters(spark):
    n = 20_100  # a chain round half a circle, so that only neighbours are near
    angle = (np.arange(n) + np.random.default_rng(1).uniform(0, 0.5, n)) * (math.pi / n)
    rows = pd.DataFrame({"id": np.arange(n), "v": np.stack([np.cos(angle), np.sin(angle)], 1).tolist()})
    points = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(8)
    eps = 1 - math.cos(1.6 * math.pi / n)
    got = clustering.average_linkage_cosine(points, eps, "id", "v").toPandas().sort_values("id")
    assert got.id.tolist() == list(range(n))
    own = got.cluster.to_numpy()
    assert (np.diff(own) >= 0).all() and n / 3 < len(set(own)) < n  # runs of neighbours, named by the first
    merged = clustering.merge_by_centroid(points.select("id", F.col("id").alias("cluster")), points, 1, 2.0)
    assert merged.where("cluster = merged").count() == n


def test_chains_are_refused_and_far_linkage_is_vetoed():
    angles = np.radians([0, 50, 100, 150])
    v = np.stack([np.cos(angles), np.sin(angles)], 1)
    assert len(set(clustering.agglomerate(1 - v @ v.T, 0.4).tolist())) == 2
    sums, sizes = np.array([[1.0, 0.0], [0.6, 0.8]]), np.array([1, 1])
    assert clustering.merge_centroids(sums, sizes, 0.35, 0.79).tolist() == [0, 0]
    assert clustering.merge_centroids(sums, sizes, 0.35, 0.3).tolist() == [0, 1]
    assert clustering.merge_centroids(sums, sizes, 0.7, 0.79).tolist() == [0, 1]
    assert clustering.merge_centroids(np.zeros((0, 2)), np.zeros(0)).tolist() == []


def test_quality_gate_holds_back_small_and_generic_faces(spark):
    rows = [(1, "0,0,100,90", [1.0, 0.0]), (2, "0,0,100,79", [1.0, 0.0]), (3, "bad", [0.0, 1.0]), (4, "0,0,80,80", [-1.0, 0.0]), (5, None, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "id bigint, bbox string, embedding array<double>")
    good = {r.id: r.good for r in clustering.quality_gate(df, 80, 2.0).collect()}
    assert good == {1: True, 2: False, 3: False, 4: True, 5: False}


def haversine(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_near_pairs_find_all_even_at_poles_and_date_line(spark):
    rng = random.Random(2)
    pts = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(120)] + [(89.99, 0.0), (89.99, 180.0), (0.0, 179.99), (0.0, -179.99), (48.8566, 2.3522), (48.8606, 2.3376)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id bigint, lat double, lon double")
    for km in (5.0, 900.0):
        got = {(r.u, r.v) for r in places.near_pairs(df, km).collect()}
        assert got == {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if haversine(pts[i], pts[j]) <= km}
    assert 340 < haversine((48.8566, 2.3522), (51.5074, -0.1278)) < 346


def test_places(spark):
    rows = [("/a", "h1", 48.8566, 2.3522), ("/b", "h2", 48.8606, 2.3376), ("/c", "h3", 51.5074, -0.1278), ("/d", "h4", None, None)]
    files = spark.createDataFrame(rows, "path string, hash string, gps_lat double, gps_lon double")
    cities = spark.createDataFrame([("Paris", "FR", 48.85, 2.35), ("", "XX", 51.5, -0.1)], "name string, cc string, lat double, lon double")
    clusters, placed = places.location_clusters(files, cities, 50)
    assert [(r.photo_count, r.name) for r in clusters.collect()] == [(2, "Paris, FR"), (1, None)]
    assert placed.count() == 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        u, v = sorted((find(a), find(b)))
        parent[v] = u
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_look_alikes_follow_the_greedy_leader(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(12)]
    rows = []
    for i in range(90):
        p = prints[i % 12]
        for _ in range(rng.randrange(9)):
            p ^= 1 << rng.randrange(63)
        rows.append((f"/{i:03d}", p))
    rows.append(("/none", None))
    got = {(r.leader, r.path) for r in similar_groups(spark.createDataFrame(rows, "path string, phash bigint")).collect()}
    free, want = [r for r in sorted(rows) if r[1] is not None], set()
    while free:
        leader, mine = free[0][0], [r for r in free if bin((r[1] ^ free[0][1]) & (2**64 - 1)).count("1") <= 10]
        if len(mine) > 1:
            want |= {(leader, r[0]) for r in mine}
        free = [r for r in free if r not in mine]
    assert got == want
