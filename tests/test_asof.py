"""As-of lookups against a search of all marks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tonegrid.operators.asof import as_of, last_not_after


def test_merged_order(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.choice((None, *range(-2, 40))), "x") for k in range(4) for i in range(50)]
    marks = [(k, t, f"m{t}", float(t)) for k in range(3) for t in rng.sample(range(30), k * 12)] + [(9, 1, "other", 0.0)]
    left = spark.createDataFrame(rows, "k long, i int, t long, _mark string")
    right = spark.createDataFrame(marks, "k long, at long, name string, v double")
    found = {(r.k, r.i): (r["name"], r.v) for r in as_of(left, right, ["k"], "t", "at", ["name", "v"]).collect()}
    expected = {}
    for k, i, t, _ in rows:
        before = [m for m in marks if m[0] == k and t is not None and m[1] <= t]
        expected[k, i] = max(before, key=lambda m: m[1])[2:] if before else (None, None)
    assert found == expected
    assert as_of(left, right, ["k"], "t", "at", ["name"]).columns == [*left.columns, "name"]
    assert as_of(left, right.limit(0), ["k"], "t", "at", ["name"]).where("name is not null").count() == 0
    assert as_of(left.limit(0), right, ["k"], "t", "at", ["name"]).count() == 0


def test_bisection(spark):
    arrays = [list(range(0, 7 * n, 7)) for n in (1, 2, 3, 4, 5, 8, 9, 31, 64, 65)] + [[3], []]
    rows = [(a, x) for a in arrays for x in range(-3, 80, 5)] + [(list(range(0, 700, 7)), x) for x in (0, 6, 7, 690, 693, 699, 10_000)]
    frame = spark.createDataFrame(rows, "a array<long>, x long").withColumn("at", last_not_after("a", lambda s: s, F.col("x")))
    for r in frame.collect():
        assert r["at"] == max([i for i, s in enumerate(r.a) if s <= r.x], default=0), r
