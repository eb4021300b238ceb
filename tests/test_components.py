import random

import pytest

from argentum.operators import components as module
from argentum.operators.components import components


def chain(order):
    return list(zip(order, order[1:]))


def run(spark, edges):
    return {r.id: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}


@pytest.fixture
def rounds(monkeypatch):
    names = []
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: names.append(name) or real(df, name))
    return names


@pytest.mark.parametrize("order", ["random", "falling"])
def test_long_chains_end_within_thirty_rounds(spark, rounds, order):
    ids = [0, *range(9_999, 0, -1)]
    if order == "random":
        random.Random(1).shuffle(ids)
    assert set(run(spark, chain(ids)).values()) == {0}
    assert rounds.count("hooked") <= 30


def test_equals_a_plain_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, 400), (7, 3), (3, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert run(spark, edges) == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert run(spark, []) == {}
