"""Chord detection: greedy steps from onset to onset, without walking them one after the other.

How far a step goes depends only on where it starts, so every note's step is worked out by itself,
from the few notes ahead of it.  Which notes are starts is then a matter of following the steps
from the first note.  No step crosses a gap that is wider than notes of one onset can lie apart, so a note
after such a gap is always a start: tracks fall into short islands, followed each for itself.  In an island
of very many notes the starts are found by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PITCH_CLASSES, TokenizerConfig
from ..functions import literal_array, quotient
from ..storage import checkpointed
from .scores import ScoreTables, section_at, with_sections

#: Notes that can be taken as one onset.
MOST_NOTES = 10
#: Islands of more notes are not gathered in a row.
LONG_ISLAND = 4096
TRACK = ["score_id", "track_idx", "program"]


def chord_name(kept: Column, c: TokenizerConfig) -> Column:
    """The name of the chord that ``kept`` notes (array of time, pitch, ...) make; null for none.

    Three to five notes within two octaves are looked up by their distances from the first one.  As
    soon as a range for unknown chords is configured all others of them are called ``ukn3`` to ``ukn5``,
    whether or not the range holds their number (a peculiarity of these vocabularies).
    """
    root, size = F.get(kept, F.lit(0)).pitch, F.size(kept)
    shape = F.array_join(F.transform(kept, lambda n: n.pitch - root), ",")
    names = {",".join(map(str, v)): k for k, v in reversed(c.chord_maps)}
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), shape) if names else F.lit(None).cast("string")
    quality = F.coalesce(known, F.concat(F.lit("ukn"), size.cast("string"))) if c.chord_unknown else known
    if c.chord_tokens_with_root_note:
        quality = F.concat(F.get(literal_array(PITCH_CLASSES, "string"), root % 12), F.lit(":"), quality)
    return F.when(size.between(3, 5) & (F.element_at(kept, -1).pitch - root <= 24), quality)


def with_steps(notes: DataFrame, c: TokenizerConfig) -> DataFrame:
    """``notes`` (TRACK, time, pitch, end, duration, velocity, tpb) with ``nth`` (from 1), ``next``, ``chord`` and ``island``.

    ``next`` is the number of the note that a step from this one leads to, and ``chord`` what it finds.  Notes within a part
    of a beat are taken together; if their ends differ from the first one's by more than
    half a beat they are passed over; of short notes only those that start exactly together count, and
    a step leads beyond all notes of the last one's tick.
    """
    order = Window.partitionBy(*TRACK).orderBy("time", "pitch", "duration", "velocity")
    beat_res = c.beat_res[min(c.beat_res)]
    half, slack = quotient(F.col("tpb"), 2), quotient(F.col("tpb"), beat_res)
    rows = notes.withColumns({"nth": F.row_number().over(order), "upto": F.count("*").over(Window.partitionBy(*TRACK).orderBy("time"))})
    ahead = F.collect_list(F.struct("time", "pitch", "end", "upto")).over(order.rowsBetween(0, MOST_NOTES - 1))
    reach = F.max(F.col("time") + slack).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"ahead": ahead, "fresh": F.when(reach >= F.col("time"), 0).otherwise(1)})
    rows = rows.withColumns({"group": F.filter("ahead", lambda n: n.time <= F.col("time") + slack), "island": F.sum("fresh").over(order)})
    rows = rows.withColumns({
        "passed": F.exists("group", lambda n: F.abs(n.end - F.col("end")) > half),
        "kept": F.when(F.col("end") - F.col("time") <= half, F.filter("group", lambda n: n.time == F.col("time"))).otherwise(F.col("group")),
    })
    ahead_of = F.when(F.col("passed"), F.col("nth") + F.size("group")).otherwise(F.element_at("kept", -1).upto + 1)
    return rows.select(*TRACK, "time", "nth", "island", ahead_of.cast("long").alias("next"), F.when(~F.col("passed"), chord_name(F.col("kept"), c)).alias("chord"))


def _by_islands(steps: DataFrame) -> DataFrame:
    """(TRACK, nth, time, chord) of the starts with a chord, each island followed in one row."""
    notes = steps.groupBy(*TRACK, "island").agg(F.array_sort(F.collect_list(F.struct("nth", "next", "time", "chord"))).alias("notes"), F.count("chord").alias("n"))
    start = F.struct(F.get("notes", F.lit(0)).nth.cast("long").alias("at"), F.slice("notes", 1, 0).alias("found"))
    step = lambda x, n: F.when(n.nth == x.at, F.struct(n.next.alias("at"), F.when(n.chord.isNotNull(), F.array_append(x.found, n)).otherwise(x.found).alias("found"))).otherwise(x)
    # Islands without any chord need not be followed.
    found = notes.where("n > 0").select(*TRACK, F.explode(F.aggregate("notes", start, step).found).alias("x"))
    return found.select(*TRACK, "x.nth", "x.time", "x.chord")


def _by_doubling(steps: DataFrame) -> DataFrame:
    """As :func:`_by_islands`: in every round all starts that are known lead to as many new ones, twice as far ahead."""
    keys = [*TRACK, "island"]
    ends = steps.groupBy(*keys).agg(F.min("nth").alias("first"), F.max("nth").alias("last"))
    rows = steps.join(ends, keys).withColumns({"start": F.col("nth") == F.col("first"), "jump": F.when(F.col("next") <= F.col("last"), F.col("next"))})
    rows = checkpointed(rows.drop("first", "last"))
    while not (moving := rows.where("jump is not null")).isEmpty():
        reached = moving.where("start").select(*keys, F.col("jump").alias("nth")).distinct().withColumn("reached", F.lit(True))
        further = rows.select(*keys, F.col("nth").alias("jump"), F.col("jump").alias("second"))
        ahead = moving.join(further, [*keys, "jump"]).select(*keys, "nth", "second")
        rows = rows.join(reached, [*keys, "nth"], "left").join(ahead, [*keys, "nth"], "left")
        rows = checkpointed(rows.withColumns({"start": F.col("start") | F.coalesce("reached", F.lit(False)), "jump": F.col("second")}).drop("reached", "second"))
    return rows.where("start and chord is not null").select(*TRACK, "nth", "time", "chord")


def chords_among(notes: DataFrame, c: TokenizerConfig, long_island: int = LONG_ISLAND) -> DataFrame:
    """(TRACK, seq, time, chord) of ``notes``, see :func:`with_steps`.  Looks ahead whether there is a long island."""
    steps = with_steps(notes, c)
    sized = steps.withColumn("notes", F.count("*").over(Window.partitionBy(*TRACK, "island")))
    found = _by_islands(sized.where(F.col("notes") <= long_island))
    long = sized.where(F.col("notes") > long_island).drop("notes")
    if not long.isEmpty():
        found = found.unionByName(_by_doubling(long))
    seq = F.row_number().over(Window.partitionBy(*TRACK).orderBy("nth")).cast("long") - 1
    return found.select(*TRACK, seq.alias("seq"), "time", "chord")


def detect_chords(tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """(score_id, track_idx, program, seq, time, chord) of all tracks but drums."""
    rows = with_sections(tables.notes.where("program <> -1"), tables, c)
    rows = rows.select(*TRACK, "time", "pitch", (F.col("time") + F.col("duration")).alias("end"), "duration", "velocity", section_at(F.col("time")).tpb.alias("tpb"))
    return chords_among(rows, c)
