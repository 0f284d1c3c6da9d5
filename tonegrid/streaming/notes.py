"""Notes from a stream of note-on and note-off marks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "score_id long, program int, pitch int, time long, duration long, velocity int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Ticks are moments of the stream, in milliseconds; tick 0 lies after the first watermark, which is 0.
SHIFT = 1


class NotePairing(StatefulProcessor):
    """Pairs the marks of one score, program and pitch, first in, first out.

    Marks wait until the watermark has passed their tick and are then taken in tick order, offs
    before ons, so that notes don't depend on how the stream was cut into batches.  A timer of each mark
    wakes it, and one of each note closes it after ``longest`` ticks.
    """

    def __init__(self, longest: int | None):
        self.longest = longest

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "tick long, is_on boolean, velocity int")
        self.open = handle.getListState("open", "tick long, velocity int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        marks = [(r.tick, r.is_on, r.velocity or 0) for r in rows if r.tick is not None and r.is_on is not None and r.tick + SHIFT > passed]
        if marks:
            self.waiting.appendList(marks)
            for tick in {m[0] for m in marks}:
                self.handle.registerTimer(tick + SHIFT)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # The stream has passed this tick: what a later timer of this batch would do is done with the first one.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) - SHIFT
        marks = [tuple(m) for m in self.waiting.get()]
        notes = [tuple(n) for n in self.open.get()]
        due = sorted(m for m in marks if m[0] <= now)
        out = []

        def close(until: int) -> None:
            while self.longest and notes and notes[0][0] + self.longest <= until:
                start, velocity = notes.pop(0)
                out.append((start, self.longest, velocity))

        for tick, is_on, velocity in due:
            close(tick - 1)
            if is_on:
                notes.append((tick, velocity))
                if self.longest:
                    self.handle.registerTimer(tick + self.longest + SHIFT)
            elif notes:
                start, loud = notes.pop(0)
                out.append((start, tick - start, loud))
        close(now)
        self._keep(self.waiting, [m for m in marks if m[0] > now])
        self._keep(self.open, notes)
        return (Row(score_id=key[0], program=key[1], pitch=key[2], time=start, duration=length, velocity=velocity) for start, length, velocity in out)

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def closed_notes(marks: DataFrame, longest: int | None = None, delay: int = 0) -> DataFrame:
    """Notes as soon as the stream has passed their end, first in, first out per score, program and pitch.

    ``marks`` is a stream of (score_id, program, pitch, tick, is_on, velocity); its watermark is the latest
    tick less ``delay``, over all keys.  Rules: offs come before ons of their tick; a mark behind the
    watermark is left out; an off without an open note is ignored; with ``longest`` a note that has
    no off by then ends there, and an off that comes later is for the next open note, if any.  Without it such a
    note stays open.  Marks without a tick or kind are left out.  State is what waits and what is open; it survives a restart from the
    query's checkpoint.  The state store has to be RocksDB, which is set here.
    """
    marks.sparkSession.conf.set(PROVIDER, ROCKS)
    timed = marks.withColumn("at", F.timestamp_millis(F.col("tick") + SHIFT)).withWatermark("at", f"{int(delay)} milliseconds")
    return timed.groupBy("score_id", "program", "pitch").transformWithState(NotePairing(longest), OUT, "Append", "eventTime")
