"""Steps of every note: rounding, equal notes, ends over a change of time signature."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegrid import queries as music
from tonegrid.functions import half_even
from tonegrid.operators.scores import deduplicate_notes

DATA = "/root/testdata/sf0.001"


def test_notes_over_changes_are_sorted_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = music.durations_resnapped(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum("Sort [" in line and " k#" in line.replace("[", " ") for line in plan.splitlines()) == 1
    assert not any("Sort [" in line and "onset#" in line and " k#" not in line for line in plan.splitlines())


def test_rounding_and_equal_notes(spark):
    values = [x / 8 for x in range(-40, 41)] + [2.4999999999999996, 0.49999999999999994, 1e15 + 0.5]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", half_even(F.col("x")).alias("y"), F.bround("x", 0).cast("long").alias("z"))
    assert all(r.y == r.z == round(r.x) for r in rows.collect())
    notes = [(1, 0, 5, 60, 4, 9), (1, 0, 5, 60, 4, 3), (1, 0, 5, 60, 2, 9), (1, 0, 5, 61, 9, 9), (1, 1, 5, 60, 8, 1), (1, 0, 6, 60, 4, 9), (2, 0, None, None, 1, 1), (2, 0, None, None, 3, 1)]
    kept = deduplicate_notes(spark.createDataFrame(notes, "score_id long, track_idx int, time long, pitch int, duration long, velocity int"))
    assert sorted(tuple(r)[:3] + (r.duration, r.velocity) for r in kept.where("time is not null").collect()) == [(1, 0, 5, 2, 9), (1, 0, 5, 9, 9), (1, 0, 6, 4, 9), (1, 1, 5, 8, 1)]
    assert kept.where("score_id = 2").count() == 1
