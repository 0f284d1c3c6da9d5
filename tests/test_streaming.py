"""Notes closed on a stream of marks: order, timers, late marks and restarts."""

from __future__ import annotations

import random

import pytest

from tonegrid.streaming.notes import closed_notes

SCHEMA = "score_id long, program int, pitch int, tick long, is_on boolean, velocity int"


class Stream:
    """Batches of marks into a stream that can be stopped and started again."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.n, self.query = spark, folder, options, 0, None
        (folder / "in").mkdir()

    def start(self):
        notes = closed_notes(self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in")), **self.options)
        self.query = notes.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "state")).outputMode("append").start()

    def feed(self, *batches):
        for marks in batches:
            rows = [(1, 0, *m) if len(m) == 4 else m for m in marks]
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(self.folder / f"batch{self.n}"))
            (part,) = (self.folder / f"batch{self.n}").glob("part-*.parquet")
            part.rename(self.folder / "in" / f"{self.n:04}.parquet")
            self.n += 1
            if self.query is None:
                self.start()
            self.query.processAllAvailable()

    def stop(self):
        self.query.stop()
        self.query = None

    def notes(self):
        return sorted((r.pitch, r.time, r.duration, r.velocity) for r in self.spark.read.parquet(str(self.folder / "out")).collect())


@pytest.fixture
def stream(spark, tmp_path):
    made = []

    def make(**options):
        made.append(Stream(spark, tmp_path, **options))
        return made[-1]

    yield make
    for s in made:
        if s.query is not None:
            s.stop()


LATER = [(99, 10_000, True, 1)]


def test_first_in_first_out_over_batches_and_a_restart(stream):
    s = stream()
    s.feed([(60, 0, True, 90), (60, 5, True, 80), (60, 9, False, 0), (61, 9, False, 0)], [(60, 20, False, 0)])
    s.stop()
    s.feed([(60, 21, True, 70), (60, 30, False, 0)], LATER, [(99, 20_000, False, 0)])
    assert s.notes() == [(60, 0, 9, 90), (60, 5, 15, 80), (60, 21, 9, 70), (99, 10_000, 10_000, 1)]


def test_a_note_without_an_off_closes_by_itself(stream):
    s = stream(longest=10)
    s.feed([(60, 0, True, 90), (60, 4, True, 80), (60, 14, False, 0), (61, 3, True, 70), (61, 50, False, 0)], LATER, [(99, 20_000, False, 0)])
    # The off at 14 comes after the first one has ended: it is for the second.
    assert s.notes() == [(60, 0, 10, 90), (60, 4, 10, 80), (61, 3, 10, 70), (99, 10_000, 10, 1)]


def test_late_marks_and_waiting_ones(stream):
    s = stream(delay=100)
    s.feed([(60, 1000, True, 90)], [(60, 950, True, 50), (60, 960, False, 0)], [(60, 1010, False, 0)], LATER, [(60, 5000, True, 9), (60, 5001, False, 0)], [(99, 30_000, False, 0), (None, 1, None, 2)], [(99, 60_000, False, 0)])
    # 950 is within the delay and comes before 1000; 5000 is behind the watermark of 9,900.
    assert s.notes() == [(60, 950, 10, 50), (60, 1000, 10, 90), (99, 10_000, 20_000, 1)]


def test_the_cut_into_batches_does_not_matter(stream):
    rng = random.Random(5)
    marks = sorted((t, rng.choice((60, 61)), rng.random() < 0.5, t) for t in rng.sample(range(300), 120))
    marks = [(p, t, on, v) for t, p, on, v in marks]
    cut = [marks[i : i + 25] for i in range(0, 120, 25)]
    for batch in cut:
        rng.shuffle(batch)
    s = stream(longest=20)
    s.feed(*cut, LATER, [(99, 30_000, False, 0)])
    expected = []
    for pitch in (60, 61):
        held = []
        for p, t, on, v in [m for m in marks if m[0] == pitch] + [(pitch, 10_000, False, 0)]:
            while held and held[0][0] + 20 < t:
                start, loud = held.pop(0)
                expected.append((pitch, start, 20, loud))
            if on:
                held.append((t, v))
            elif held:
                start, loud = held.pop(0)
                expected.append((pitch, start, t - start, loud))
    assert s.notes() == sorted([*expected, (99, 10_000, 20, 1)])
