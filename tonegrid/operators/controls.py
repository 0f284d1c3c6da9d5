"""Attribute controls: descriptors of bars and tracks as tokens.

Inputs are the notes of preprocessed scores and the bar ticks of :func:`.scores.bars`; outputs are
(score_id, track_idx, bar, token), with a null bar for descriptors of whole tracks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions import literal_array, token
from .asof import as_of

# Note lengths by name, in quarter notes.
LENGTHS = (("Whole", 4.0), ("Half", 2.0), ("Quarter", 1.0), ("Eight", 0.5), ("Sixteenth", 0.25), ("ThirtySecond", 0.125))
TRACK = ["score_id", "track_idx"]


def with_bar(notes: DataFrame, bars: DataFrame) -> DataFrame:
    """Notes with ``bar`` (number) and ``bar_tick`` of the bar that holds their onset; -1 and null before the first one."""
    rows = as_of(notes, bars.select("score_id", F.col("n").alias("bar"), F.col("tick").alias("bar_tick")), ["score_id"], "time", "bar_tick", ["bar", "bar_tick"])
    return rows.withColumn("bar", F.coalesce("bar", F.lit(-1).cast("long")))


def _out(df: DataFrame, bar: Column | None, *tokens: Column) -> DataFrame:
    one = F.explode(F.array(*tokens)).alias("token")
    return df.select(*TRACK, (F.lit(None).cast("long") if bar is None else bar).alias("bar"), one)


def bar_density(notes: DataFrame, c: TokenizerConfig) -> DataFrame:
    most = c.ac_note_density_bar_max
    n = notes.groupBy(*TRACK, "bar").agg(F.count("*").alias("n"))
    name = F.when(F.col("n") >= most, F.lit(f"ACBarNoteDensity_{most}+")).otherwise(token("ACBarNoteDensity", F.col("n")))
    return _out(n, F.col("bar"), name)


def _polyphony(notes: DataFrame, keys: list[str], c: TokenizerConfig, name: str) -> DataFrame:
    lo, hi = c.ac_polyphony_min, c.ac_polyphony_max
    onsets = notes.groupBy(*keys, "time").agg(F.count("*").alias("n"))
    ends = onsets.groupBy(*keys).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    least = F.least(F.greatest("least", F.lit(lo)), F.lit(hi))
    return _out(ends, F.col("bar") if "bar" in keys else None, token(f"{name}Min", least), token(f"{name}Max", F.least("most", F.lit(hi))))


def bar_polyphony(notes: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Fewest and most notes that start together in a bar, within the configured range."""
    return _polyphony(notes, [*TRACK, "bar"], c, "ACBarOnsetPolyphony")


def track_polyphony(notes: DataFrame, c: TokenizerConfig) -> DataFrame:
    return _polyphony(notes, TRACK, c, "ACTrackOnsetPolyphony")


def bar_pitch_class(notes: DataFrame, c: TokenizerConfig) -> DataFrame:
    kinds = notes.select(*TRACK, "bar", (F.col("pitch") % 12).alias("kind")).distinct()
    return _out(kinds, F.col("bar"), token("ACBarPitchClass", F.col("kind")))


def _lengths(notes: DataFrame, keys: list[str], tpq: int, name: str) -> DataFrame:
    found = [F.max(F.when(F.col("duration") == F.lit(tpq * f), 1).otherwise(0)).alias(n) for n, f in LENGTHS]
    rows = notes.groupBy(*keys).agg(*found)
    return _out(rows, F.col("bar") if "bar" in keys else None, *(token(f"{name}{n}", F.col(n)) for n, _ in LENGTHS))


def bar_durations(notes: DataFrame, c: TokenizerConfig) -> DataFrame:
    """For each note length whether a bar has a note of it."""
    return _lengths(notes, [*TRACK, "bar"], c.max_positions_per_beat, "ACBarNoteDuration")


def track_durations(notes: DataFrame, c: TokenizerConfig) -> DataFrame:
    return _lengths(notes, TRACK, c.max_positions_per_beat, "ACTrackNoteDuration")


def track_density(notes: DataFrame, bars: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Fewest and most notes of a track in a bar, empty bars included."""
    most = c.ac_note_density_track_max
    count = bars.groupBy("score_id").agg(F.count("*").alias("bars"))
    n = notes.groupBy(*TRACK, "bar").agg(F.count("*").alias("n"))
    ends = n.groupBy(*TRACK).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("full")).join(count, "score_id")
    least = F.when(F.col("full") < F.col("bars"), F.lit(0)).otherwise(F.col("least"))
    name = lambda which, v: F.when(v >= most, F.lit(f"ACTrackNoteDensity{which}_{most}+")).otherwise(token(f"ACTrackNoteDensity{which}", v))
    return _out(ends, None, name("Min", least), name("Max", F.col("most")))


def track_repetition(notes: DataFrame, bars: DataFrame, c: TokenizerConfig) -> DataFrame:
    """How alike the bars of a track are to those that follow them, as the nearest of equal bins.

    A bar is the set of its onset and offset cells (kind, pitch, tick in the bar).  For every bar
    and each of the next few bars of equal length: the share of the first one's cells that the
    second has; averaged over the track.  Cells meet in an equi-join on their place, so bars that
    share nothing never meet.
    """
    spans = bars.withColumn("length", F.lead("tick").over(Window.partitionBy("score_id").orderBy("n")) - F.col("tick")).select("score_id", "n", "tick", "length")
    cells = notes.select(*TRACK, "pitch", F.explode(F.array(F.struct(F.lit("on").alias("kind"), F.col("time").alias("t")), F.struct(F.lit("off").alias("kind"), (F.col("time") + F.col("duration")).alias("t")))).alias("cell"))
    cells = cells.select(*TRACK, "pitch", F.col("cell.kind").alias("kind"), F.col("cell.t").alias("time")).distinct()
    placed = with_bar(cells, bars).withColumn("place", F.col("time") - F.col("bar_tick")).drop("bar_tick", "time")
    filled = placed.groupBy(*TRACK, "bar").agg(F.count("*").alias("cells"))
    reach = c.ac_repetition_track_num_consec_bars
    # The bar ahead is part of the key, so that cells of a place that many bars fill meet only those near.
    ahead_of = F.explode(F.sequence(F.col("bar") + 1, F.col("bar") + reach - 1)).alias("other")
    wanted = placed.select(*TRACK, "pitch", "kind", "place", "bar", ahead_of)
    second_bar = placed.select(*TRACK, "pitch", "kind", "place", F.col("bar").alias("other"))
    shared = wanted.join(second_bar, [*TRACK, "pitch", "kind", "place", "other"]).groupBy(*TRACK, "bar", "other").agg(F.count("*").alias("shared"))
    lengths = spans.select("score_id", F.col("n").alias("bar"), "length")
    ahead = filled.join(lengths, ["score_id", "bar"]).where("length is not null")
    pairs = ahead.withColumn("other", F.explode(F.sequence(F.col("bar") + 1, F.col("bar") + reach - 1)))
    second = spans.select("score_id", F.col("n").alias("other"), F.col("length").alias("other_length"))
    pairs = pairs.join(second, ["score_id", "other"]).where("other_length = length")
    alike = pairs.join(shared, [*TRACK, "bar", "other"], "left").groupBy(*TRACK).agg(F.avg(F.coalesce("shared", F.lit(0)) / F.col("cells")).alias("mean"))
    bins = [float(b) for b in np.linspace(0, 1, c.ac_repetition_track_num_bins)]
    far = F.transform(literal_array(bins, "double"), lambda b: F.struct(F.abs(b - F.col("mean")).alias("far"), b.alias("bin")))
    best = F.array_min(far).getField("bin")  # of two as near the lower
    return _out(alike, None, token("ACTrackRepetition", F.format_string("%.2f", best)))


@dataclass(frozen=True)
class Control:
    """A descriptor: ``names`` are the tokens it can make, in the order in which they stand for one bar.

    ``rows`` makes (score_id, track_idx, bar, token) from notes with their bar, bar ticks and the
    configuration.  A control ``of_bars`` stands at the start of each bar asked for, any other at
    the start of its track.  Own ones are used like those that a configuration switches on.
    """

    names: tuple[str, ...]
    rows: Callable[[DataFrame, DataFrame, TokenizerConfig], DataFrame]
    of_bars: bool = True


def _numbered(name: str, values: Iterable) -> list[str]:
    return [f"{name}_{v}" for v in values]


def available(c: TokenizerConfig) -> tuple[Control, ...]:
    """The controls that a configuration switches on; a request names them by their place here."""
    heard = range(c.ac_polyphony_min, c.ac_polyphony_max + 1)
    most, track_most = c.ac_note_density_bar_max, c.ac_note_density_track_max
    dense = [*range(c.ac_note_density_track_min, track_most), f"{track_most}+"]
    ends = lambda name, values: tuple(f"{name}{end}_{v}" for v in values for end in ("Min", "Max"))
    told = lambda name: tuple(f"{name}{n}_{yes}" for n, _ in LENGTHS for yes in (0, 1))
    alike = tuple(f"ACTrackRepetition_{b:.2f}" for b in np.linspace(0, 1, c.ac_repetition_track_num_bins))
    every = [
        (c.ac_polyphony_track, Control(ends("ACTrackOnsetPolyphony", heard), lambda n, b, c: track_polyphony(n, c), of_bars=False)),
        (c.ac_polyphony_bar, Control(ends("ACBarOnsetPolyphony", heard), lambda n, b, c: bar_polyphony(n, c))),
        (c.ac_pitch_class_bar, Control(tuple(_numbered("ACBarPitchClass", range(12))), lambda n, b, c: bar_pitch_class(n, c))),
        (c.ac_note_density_track, Control(ends("ACTrackNoteDensity", dense), track_density, of_bars=False)),
        (c.ac_note_density_bar, Control(tuple(_numbered("ACBarNoteDensity", [*range(most), f"{most}+"])), lambda n, b, c: bar_density(n, c))),
        (c.ac_note_duration_bar, Control(told("ACBarNoteDuration"), lambda n, b, c: bar_durations(n, c))),
        (c.ac_note_duration_track, Control(told("ACTrackNoteDuration"), lambda n, b, c: track_durations(n, c), of_bars=False)),
        (c.ac_repetition_track, Control(alike, lambda n, b, c: track_repetition(n.drop("bar", "bar_tick"), b, c), of_bars=False)),
    ]
    return tuple(control for on, control in every if on)


def controls(notes: DataFrame, bars: DataFrame, c: TokenizerConfig) -> DataFrame:
    """All descriptors that the configuration switches on."""
    rows = with_bar(notes, bars)
    made = [control.rows(rows, bars, c) for control in available(c)]
    return reduce(DataFrame.unionByName, made) if made else rows.select(*TRACK, "bar", F.lit("").alias("token")).limit(0)


def asked_of_all(notes: DataFrame, bars: dict[int, list[int] | None]) -> DataFrame:
    """A request, (score_id, track_idx, control, bars), for the same controls and bars of every track; no list: all bars."""
    one = [F.struct(F.lit(i).alias("control"), (F.lit(None) if b is None else literal_array(list(b), "bigint")).cast("array<bigint>").alias("bars")) for i, b in bars.items()]
    return notes.select(*TRACK).distinct().select(*TRACK, F.explode(F.array(*one)).alias("r")).select(*TRACK, "r.control", "r.bars")


def requested(notes: DataFrame, bars: DataFrame, request: DataFrame, controls: tuple[Control, ...], c: TokenizerConfig) -> DataFrame:
    """(score_id, track_idx, tick, control, place, token): what a request asks for.

    ``tick`` is the start of the bar, null for a whole track.  A bar asked for also describes the
    notes since the one asked for before it, as is usual for these tokens; bars without such notes
    and bars past a track's last note give none.
    """
    rows = with_bar(notes, bars).withColumn("last", F.max("bar").over(Window.partitionBy(*TRACK)))
    starts = bars.select("score_id", F.col("n").alias("bar"), "tick")
    made = []
    for i, control in enumerate(controls):
        own = rows.join(request.where(F.col("control") == i).select(*TRACK, "bars"), TRACK)
        if control.of_bars:
            near = F.array_min(F.filter("bars", lambda b: (b >= F.col("bar")) & (b <= F.col("last"))))
            own = own.withColumn("bar", F.when(F.col("bars").isNull(), F.col("bar")).otherwise(near)).where("bar is not null")
        out = control.rows(own.drop("bars", "last"), bars, c)
        place = F.array_position(literal_array(list(control.names), "string"), F.col("token")).cast("int")
        out = out.join(starts, ["score_id", "bar"]) if control.of_bars else out.withColumn("tick", F.lit(None).cast("long"))
        made.append(out.select(*TRACK, "tick", F.lit(i).alias("control"), place.alias("place"), "token"))
    return reduce(DataFrame.unionByName, made)
