"""Chord detection against walking the notes one by one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tonegrid.config import PITCH_CLASSES, TokenizerConfig
from tonegrid.operators.chords import TRACK, chords_among

CONFIG = TokenizerConfig(chord_tokens_with_root_note=True, chord_unknown=(3, 4))


def walked(notes, c):
    """(time, name) of notes (time, pitch, end, velocity) of one track at eight ticks a beat."""
    notes = sorted(notes, key=lambda n: (n[0], n[1], n[2] - n[0], n[3]))
    known = {tuple(v): k for k, v in reversed(c.chord_maps)}
    out, i, seen = [], 0, None
    while i < len(notes):
        start, root, end = notes[i][:3]
        if start == seen:
            i += 1
            continue
        near = [n for n in notes[i : i + 10] if n[0] <= start + 1]
        if any(abs(n[2] - end) > 4 for n in near):
            i += len(near)
            continue
        if end - start <= 4:
            near = [n for n in near if n[0] == start]
        shape = tuple(n[1] - root for n in near)
        if 3 <= len(near) <= 5 and shape[-1] <= 24:
            name = known.get(shape, f"ukn{len(near)}" if c.chord_unknown else None)
            if name:
                out.append((start, f"{PITCH_CLASSES[root % 12]}:{name}"))
        seen = near[-1][0]
        i += len(near)
    return out


def table(spark, tracks):
    rows = [(1, k, 0, t, p, e - t, v, e, 8) for k, notes in enumerate(tracks) for t, p, e, v in notes]
    return spark.createDataFrame(rows, "score_id long, track_idx int, program int, time long, pitch int, duration long, velocity int, end long, tpb long")


def found(frame, n):
    rows = frame.orderBy("track_idx", "seq").collect()
    return [[(r.time, r.chord) for r in rows if r.track_idx == k] for k in range(n)]


def dense_track(rng, n, spread):
    """Chords and single notes, some of their notes late, some longer than the others."""
    out = []
    for _ in range(n):
        t, root, length = rng.randrange(spread), rng.choice((40, 47, 60)), rng.choice((2, 4, 8, 9))
        for step in rng.choice(((0,), (0, 4, 7), (0, 3, 7), (0, 5), (0, 2, 9), (0, 4, 7, 11))):
            start = t + (rng.random() < 0.15)
            out.append((start, root + step, t + length + (7 if rng.random() < 0.1 else 1), rng.randrange(3)))
    return out


def test_random_tracks_and_long_islands(spark):
    rng = random.Random(4)
    tracks = [dense_track(rng, n, spread) for n, spread in ((1, 5), (3, 1), (30, 9), (200, 4000), (100, 60), (150, 300), (300, 9000))]
    tracks += [[(t, p, t + 8, 1) for t in range(0, 60, 12) for p in (60, 64, 67)], [(3, 60 + i, 11, 1) for i in range(25)]]
    expected = [walked(t, CONFIG) for t in tracks]
    assert sum(map(len, expected)) > 150
    for long_island in (4096, 20, 1):
        assert found(chords_among(table(spark, tracks), CONFIG, long_island), len(tracks)) == expected


def test_names(spark):
    triad = [(0, 60, 8, 1), (0, 64, 8, 1), (0, 67, 8, 1)]
    four = [(0, p, 8, 1) for p in (60, 61, 62, 63)]
    names = lambda notes, **c: [x[1] for x in found(chords_among(table(spark, [notes]), TokenizerConfig(**c)), 1)[0]]
    assert names(triad) == ["maj"] and names(four) == []
    # Any number of notes gets a name once there is a range, in the range or not.
    assert names(four, chord_unknown=(3, 4)) == ["ukn4"]
    assert names([*triad[:2], (0, 90, 8, 1)], chord_unknown=(3, 4)) == []
    assert names(triad, chord_maps=()) == []


def test_no_notes(spark):
    assert chords_among(table(spark, [[(0, 60, 4, 1)]]).where(F.lit(False)), CONFIG).count() == 0
    assert chords_among(table(spark, [[(0, 60, 4, 1)]]), CONFIG).columns == [*TRACK, "seq", "time", "chord"]
