"""The data source of MIDI files: planning, damaged files, kinds, and writing in stages."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tonegrid.operators.scores import ScoreTables, pedal_controls, with_default_tempo
from tonegrid.sources.midi import KINDS, bad_files, compose, midi_rows, parse, read_midi, write_midi
from tonegrid.sources.midi_source import planned

NOTE = "score_id long, track_idx int, program int, time long, duration long, pitch int, velocity int"


def score(spark, n, shift=0):
    notes = spark.createDataFrame([(i, 0, 0, k * 10 + shift, 5, 60 + k, 90) for i in range(n) for k in range(3)], NOTE)
    return ScoreTables(notes.select("score_id").distinct().withColumn("tpq", F.lit(480)), notes)


def visible(folder):
    return sorted(os.listdir(folder))


def test_files_are_planned_by_size():
    files = [("c", 30), ("a", 10), ("b", 25), ("d", 500), ("e", 1), ("f", 0)]
    assert [p.paths for p in planned(files, 40)] == [["a", "b"], ["c"], ["d"], ["e", "f"]]
    assert planned([], 40) == [] and [p.paths for p in planned([("x", 0), ("y", 0)], 40)] == [["x", "y"]]


def test_damaged_files_are_rows(spark, tmp_path):
    good = compose(96, [("note", 0, 0, 5, 10, 60, 64, None), ("pedal", 0, 0, 0, 9, 0, 0, None)])
    (tmp_path / "deep" / "er").mkdir(parents=True)
    files = {"good.mid": good, "deep/er/other.MIDI": good, "cut.mid": good[:-20], "text.mid": b"RIFF1234", "empty.mid": b"", "smpte.mid": good[:12] + b"\xe7\x28" + good[14:], "notes.txt": good}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = midi_rows(spark, str(tmp_path))
    assert {os.path.basename(r.path) for r in bad_files(rows).collect()} == {"cut.mid", "text.mid", "empty.mid", "smpte.mid"}
    assert all(r.reason for r in bad_files(rows).collect())
    kinds = lambda *k: sorted((os.path.basename(r.path), r.kind) for r in midi_rows(spark, str(tmp_path), k).collect())
    assert kinds("note") == [("good.mid", "note"), ("other.MIDI", "note")]
    assert {k for _, k in kinds("pedal", "error")} == {"pedal", "error"}
    assert read_midi(spark, str(tmp_path)).notes.count() == 2
    with pytest.raises(Exception, match="unknown kinds"):
        midi_rows(spark, str(tmp_path), ("lyrics",)).count()
    with pytest.raises(Exception, match="nowhere"):
        midi_rows(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "none").mkdir()
    assert midi_rows(spark, str(tmp_path / "none")).count() == 0
    assert midi_rows(spark, f"file:{tmp_path}/good.mid", ("score",)).count() == 1


def test_only_the_kinds_asked_for_are_made():
    data = compose(96, [("note", 0, 0, 0, 10, 60, 64, None), ("pedal", 0, 0, 0, 9, 0, 0, None), ("bend", 0, 0, 3, 0, -5, 0, None), ("tempo", -1, 0, 0, 0, 0, 0, 400000.0)])
    whole = parse(data)
    assert {r[0] for r in whole} == set(KINDS) - {"error"}
    for k in KINDS:
        assert parse(data, (k,)) == [r for r in whole if r[0] == k]


def test_writing_reads_back_and_overwrites(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_midi(score(spark, 5), folder)
    assert visible(folder) == [f"{i}.mid" for i in range(5)]
    write_midi(score(spark, 2, shift=7), folder)
    assert visible(folder) == [f"{i}.mid" for i in range(5)]
    times = lambda: sorted({r.time for r in midi_rows(spark, f"{folder}/1.mid", ("note",)).collect()})
    assert times() == [7, 17, 27]
    (tmp_path / "out" / "readme.txt").write_text("stays")
    write_midi(score(spark, 2), folder, mode="overwrite")
    assert visible(folder) == ["0.mid", "1.mid", "readme.txt"] and times() == [0, 10, 20]
    write_midi(ScoreTables(score(spark, 1).scores.limit(0), score(spark, 1).notes.limit(0)), str(tmp_path / "void"))
    assert visible(tmp_path / "void") == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from tonegrid.sources.midi_source import MidiSource

    spark.dataSource.register(MidiSource)
    good = [(str(i), b"x") for i in range(20)]
    for bad in ([("a/b", b"x")], [(None, b"x")], [("3", b"y")]):
        folder = tmp_path / f"out{len(bad[0][0] or '')}{bad[0][1]}"
        frame = spark.createDataFrame(good + bad, "name string, content binary").repartition(4)
        with pytest.raises(Exception, match="name"):
            frame.write.format("midi").mode("append").save(str(folder))
        assert not folder.exists() or visible(folder) == []
    with pytest.raises(Exception, match="columns name and content"):
        spark.range(1).write.format("midi").mode("append").save(str(tmp_path / "other"))


def test_pedals_as_controls_and_default_tempos(spark):
    pedals = spark.createDataFrame([(1, 0, 5, 10, 30), (1, 0, 5, 40, 5)], "score_id long, track_idx int, program int, time long, duration long")
    assert sorted(tuple(r) for r in pedal_controls(pedals).select("time", "number", "value").collect()) == [(10, 64, 127), (40, 64, 0), (40, 64, 127), (45, 64, 0)]
    tempos = spark.createDataFrame([(1, 0, 0, 5e5), (2, 0, 9, 4e5)], "score_id long, seq int, time long, mspq double")
    scores = spark.createDataFrame([(1, 480), (2, 480), (3, 480)], "score_id long, tpq int")
    assert sorted((r.score_id, r.time, r.mspq) for r in with_default_tempo(tempos, scores, 100.0).collect()) == [(1, 0, 5e5), (2, 0, 6e5), (2, 9, 4e5), (3, 0, 6e5)]
