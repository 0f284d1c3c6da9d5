from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import neighbours


def table(spark, n=3000, d=16):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + 0.7 * rng.normal(size=(n, d))
    x[100:700] = x[100]  # a hot vector
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    odd = [(n, None), (n + 100, [0.0] * d), (n + 200, [float("nan")] * d), (n + 300, [None, *[1.0] * (d - 1)]), (n + 400, [1.0] * (d + 1)), (n + 500, [float("inf"), *[1.0] * (d - 1)]), (0, rows[0][1])]
    return rows, spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, rank string").repartition(5)


def test_recall_scores_and_ties(spark):
    rows, df = table(spark)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = neighbours.search(df, F.col("vec_id") % 100 == 0, k=10, list_rows=64).collect()
    by: dict = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 100))
    hit = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 and r.vec_id != q for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        true = [i for i in np.lexsort((ids, d)) if i != q][:10]
        hit += len({r.vec_id for r in own} & set(true))
    assert hit / (10 * len(by)) >= 0.9
    assert [r.vec_id for r in by[100]] == list(range(101, 111))  # equal vectors: the smaller ids


def test_few_rows_and_none(spark):
    _, df = table(spark, 900)
    two = df.where("vec_id in (0, 1)")
    assert {(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(two, F.col("vec_id") == 0).collect()} == {(0, 1, 1)}
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_outliers_find_k_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 20  # far from all others, on a centroid of its own
    x[11], x[12] = 9 * x[10], 9 * x[10]  # so are two copies
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    for list_rows in (4, 20):
        by: dict = {}
        for r in neighbours.search(df, F.col("vec_id").isin(7, 11, 50), k=10, list_rows=list_rows).collect():
            by.setdefault(r.query_id, []).append(r)
        assert {q: len(own) for q, own in by.items()} == {7: 10, 11: 10, 50: 10}
        assert min(by[11], key=lambda r: r["rank"]).vec_id == 12
    far = {i for i in np.argsort(((x - x[7]) ** 2).sum(1))[1:11].tolist()}
    assert len({r.vec_id for r in by[7]} & far) >= 9


def test_lists_are_probed_until_k_rows_are_covered():
    line = np.arange(200.0)[:, None]
    g = neighbours.CentroidGraph.of(np.hstack([line, 0 * line]))
    held = np.zeros(200, np.int64)
    held[[0, 150, 190]] = 1, 10, 5  # all other lists are empty
    row, lists = neighbours.probed(g, np.array([[0.0, 0.0], [190.0, 0.0]]), held, 10, 24, 1.25)
    assert held[lists[row == 0]].sum() > 10 and held[lists[row == 1]].sum() > 10
    row, lists = neighbours.probed(g, np.array([[0.0, 0.0]]), held, 100, 24, 1.25)
    assert sorted(lists) == list(range(200))


def test_the_share_of_lists_probed_holds_at_any_size():
    for lists in (400, 1000, 4096):
        assert neighbours.probed_lists(lists) == int(neighbours.PROBE_SHARE * lists)
    assert neighbours.probed_lists(40) == neighbours.PROBE_LEAST and neighbours.probed_lists(3) == 3


def test_a_wide_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    g = neighbours.CentroidGraph.of(rng.normal(size=(neighbours.MAX_LISTS, 16)))
    v = rng.normal(size=(8, 16))
    count = neighbours.probed_lists(neighbours.MAX_LISTS)
    ids, _ = g.nearest(v, count)
    true = np.argsort(neighbours.squared(v, g.centroids), axis=1)[:, :count]
    assert np.mean([len(set(a) & set(b)) / count for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.99


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(0)
    g = neighbours.CentroidGraph.of(rng.normal(size=(300, 8)))
    v = rng.normal(size=(50, 8))
    ids, d = g.nearest(v, 5)
    true = np.argsort(neighbours.squared(v, g.centroids), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.95
    assert d.shape == (50, 5) and pytest.approx(d[:, 0]) == np.sqrt(neighbours.squared(v, g.centroids).min(1))
