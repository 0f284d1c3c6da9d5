"""Tracks of one program merged with all that belongs to them."""

from __future__ import annotations

from tonegrid.operators.scores import ScoreTables, merge_same_program

KEYS = "score_id long, track_idx int, program int"


def tables(spark, tracks):
    make = lambda rows, more: spark.createDataFrame(rows, f"{KEYS}, {more}")
    notes = make([(1, i, p, 10 * i, 5, 60 + i, 90) for i, p in enumerate((0, 5, 0, -1, 0))] + [(2, 0, 0, 0, 5, 40, 80)], "time long, duration long, pitch int, velocity int")
    pedals = make([(1, 0, 0, 0, 9), (1, 2, 0, 3, 4)], "time long, duration long")
    bends = make([(1, 4, 0, 7, -5)], "time long, value int")
    controls = make([(1, 2, 0, 1, 7, 100), (1, 1, 5, 2, 10, 64)], "time long, number int, value int")
    names = make([(1, 0, 0, "Piano"), (1, 1, 5, None), (1, 2, 0, "Keys"), (1, 3, -1, "Kit"), (1, 4, 0, None), (1, 6, 5, "Empty"), (2, 0, 0, "Solo")], "name string") if tracks else None
    return ScoreTables(notes.select("score_id").distinct(), notes, pedals=pedals, pitch_bends=bends, controls=controls, tracks=names)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_with_effects(spark):
    m = merge_same_program(tables(spark, True))
    assert got(m.tracks, "score_id", "track_idx", "program", "name") == [(1, 0, 0, "Piano / Keys / "), (1, 1, 5, " / Empty"), (1, 3, -1, "Kit"), (2, 0, 0, "Solo")]
    assert got(m.notes, "score_id", "track_idx", "pitch") == [(1, 0, 60), (1, 0, 62), (1, 0, 64), (1, 1, 61), (1, 3, 63), (2, 0, 40)]
    assert got(m.pedals, "track_idx", "time") == [(0, 0), (0, 3)] and got(m.pitch_bends, "track_idx", "time") == [(0, 7)]
    assert got(m.controls, "track_idx", "number") == [(0, 7), (1, 10)] and m.controls.columns == tables(spark, True).controls.columns


def test_without_effects_and_names(spark):
    m = merge_same_program(tables(spark, False), effects=False)
    assert got(m.tracks, "score_id", "track_idx", "name") == [(1, 0, "Acoustic Grand Piano / Acoustic Grand Piano / Acoustic Grand Piano"), (1, 1, "Electric Piano 2"), (1, 3, "Drums"), (2, 0, "Acoustic Grand Piano")]
    assert got(m.notes, "track_idx", "pitch") == [(0, 40), (0, 60), (0, 62), (0, 64), (1, 61), (3, 63)]
    assert got(m.pedals, "track_idx", "time") == [(0, 0)] and got(m.pitch_bends, "time") == [] and got(m.controls, "number") == [(10,)]
