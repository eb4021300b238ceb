import math
import random
from fractions import Fraction

import pytest

from argentum.llm.top_k import exact_top_k


def whole(v):
    return [math.floor(256 * Fraction(x)) for x in v]


def slowly(rows, k, every=50):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, whole(v)))
    queries = {}
    for i, v in ok:
        if i % every == 0:
            raw = next(r for j, r in rows if j == i and r is not None and whole(r) == v)
            if i not in queries or raw < queries[i][0]:
                queries[i] = (raw, v)
    out = []
    for q, (_, v) in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, None, "clash") for i, v in rows], "vec_id bigint, embedding array<double>, score string, rank string").repartition(4)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_top_k(df, **options).collect())


def vectors(n=300, d=6, seed=0):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(d)]) for i in range(n)]
    same = [0.5] * d
    rows += [(1000 + i, same) for i in range(100)]  # ties: the smallest ids win
    rows += [(2000, None), (2050, [0.1] * (d - 1) + [None]), (2100, [math.nan] * d), (2150, [math.inf] * d), (None, [1.0] * d), (2200, [0.2] * (d + 1)), (2201, [0.3] * (d + 1)), (2250, []), (2300, [1e12] * d), (2301, [-1e12] * d), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("options", [{}, {"k": 1}, {"k": 200, "bins": 7}, {"chunk_size": 3, "bins": 2}])
def test_equals_brute_force(spark, options):
    rows = vectors()
    assert run(spark, rows, **options) == slowly(rows, options.get("k", 5))


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-(2**20), 2**20) for _ in range(3)]) for i in range(60)]
    assert run(spark, rows) == slowly(rows, 5)


def test_huge_finite_components_take_part(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1), 0.0]) for i in range(1, 40)]
    rows += [(0, [1.0, 0.5, 2.0**-8]), (41, [2.0**46, 0.0, 0.0]), (42, [-(2.0**54), 1.0, 0.0]), (43, [0.0, 0.0, 2.0**53])]
    exact = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    scores = sorted((-sum(a * b for a, b in zip(exact[0], w)), i) for i, w in exact.items() if i)
    assert run(spark, rows) == [(0, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert scores[0][1] == 41 and scores[1][1] == 43


def test_scores_beyond_a_long(spark):
    rows = [(0, [2.0**30, 1.0])] + [(i, [-(2.0**40) * i, float(i)]) for i in range(1, 20)] + [(i, [0.0, float(i)]) for i in range(20, 30)]
    assert [r[2:] for r in run(spark, rows)] == [(i, 65536 * i) for i in (29, 28, 27, 26, 25)]
    with pytest.raises(Exception, match="score of query 0 with vector 1 does not fit a long"):
        run(spark, [(0, [2.0**30]), (1, [2.0**40])])


def test_any_finite_size_takes_part(spark):
    rng = random.Random(8)
    rows = [(0, [1e9, 0.0]), (1, [1e5, 0.0]), (2, [-1e8, 3.0]), (3, [12345.678, 1e9])] + [(i, [0.0, 0.0]) for i in range(10, 16)]
    got = run(spark, rows)
    assert got == slowly(rows, 5) and got[0][2] == 1
    scales = [1e-3, 1.0, 1e3, 1e6, 1e9, 1e20, 1e300, 1.7e308]
    # queries of all sizes; what their huge components meet is zero, or lowers the score
    rows = [(0, [1.0, 0.0, -1.0]), (50, [1e9, 0.0, 0.0]), (100, [0.0, -1e20, 0.0]), (150, [0.0, 0.0, 1.7e308])]
    rows += [(i, [-rng.uniform(0, 1) * rng.choice(scales), rng.uniform(0, 1) * rng.choice(scales), -rng.uniform(0, 1) * 1e-3]) for i in range(151, 190)]
    rows += [(i, [0.0, 0.0, 0.0]) for i in range(191, 198)]
    assert run(spark, rows) == slowly(rows, 5)
    alone = [(0, [1e20, 1.0]), (1, [0.0, 2.0])]
    assert run(spark, alone) == slowly(alone, 5) == [(0, 1, 1, 256 * 512)]


def test_results_below_a_long_are_errors(spark):
    with pytest.raises(Exception, match="score of query 0 with vector 1 does not fit a long"):
        run(spark, [(0, [1e20]), (1, [-1.0])])


def test_fewer_candidates_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [1.0, 2.0, 3.0])]
    assert run(spark, rows) == [(0, 1, 1, 128 * 256 + 128 * 512)]
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
