from __future__ import annotations

import random

import pytest

from tonegrid.llm import components as module
from tonegrid.llm.components import components
from tonegrid.llm.skew import joined


@pytest.mark.parametrize("limit", [None, 3])
def test_components_of_random_graphs_chains_and_hubs(spark, monkeypatch, limit):
    if limit:  # hubs are joined apart
        monkeypatch.setattr(module, "hot_limit", lambda rows: limit)
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)]
    edges = [e for e in edges if e[0] != e[1]]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(x, root(x)) for e in edges for x in e}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [0, 5, 1000])
def test_a_join_apart_gives_the_rows_of_a_join(spark, limit):
    many = spark.createDataFrame([(i, 7 if i < 40 else i) for i in range(100)], "i long, k long")
    one = many.where("k % 2 = 1").groupBy("k").count().selectExpr("k", "count as n", "k * 10 as v")
    assert sorted(joined(many, one, "k", "n", limit).select("i", "k", "v").collect()) == sorted(many.join(one, "k").select("i", "k", "v").collect())
