"""Decoders: token sequences back to score tables.

Ticks are running sums of what the time tokens add; notes are put together from the tokens that
follow their pitch (lead), programs from the last program token before (last value).  Rests feed a
note's end back into the clock; what they add is a running sum too.  Where bars follow such a clock
(REMI with rests) a bar number is rounded down from it, which no sum expresses; these streams are folded.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_VELOCITY, TokenizerConfig
from ..functions import qpm_to_mspq, quotient, token_type, token_value
from ..grids import Grids, TickTable
from .asof import last_not_after

SEQ = ["score_id", "seq_idx"]
PITCHED = ("Pitch", "PitchDrum", "NoteOn", "DrumOn", "PitchIntervalTime", "PitchIntervalChord")


@dataclass(frozen=True)
class Decoded:
    """notes (score_id, seq_idx, program, time, duration, pitch, velocity), tempos, time_signatures, pedals, pitch_bends."""

    notes: DataFrame
    tempos: DataFrame
    time_signatures: DataFrame
    pedals: DataFrame
    pitch_bends: DataFrame


def by_place() -> Window:
    return Window.partitionBy(*SEQ).orderBy("pos")


def before() -> Window:
    return by_place().rowsBetween(Window.unboundedPreceding, 0)


def ticks_of(name: Column, table: TickTable) -> Column:
    """Ticks of a span's name; null for an unknown one."""
    pairs = ",".join(f'"{n}":{t}' for n, t in zip(table.names, table.ticks, strict=True))
    return F.try_element_at(F.expr("from_json('{%s}', 'map<string,int>')" % pairs), name).cast("long")


def parsed(tokens: DataFrame) -> DataFrame:
    return tokens.select(*SEQ, "pos", "token", token_type(F.col("token")).alias("type"), token_value(F.col("token")).alias("value"))


def with_ticks_per_beat(rows: DataFrame, c: TokenizerConfig) -> DataFrame:
    """``tpb``: ticks per beat of the last time signature at or before each token, at the decoder's resolution."""
    g = Grids(c)
    of = g.ticks_per_beat
    default = of.get(4, g.positions_per_beat)
    if not c.use_time_signatures:
        return rows.withColumn("tpb", F.lit(default))
    den = F.when(F.col("type") == "TimeSig", F.substring_index("value", "/", -1).cast("int"))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), den)
    return rows.withColumn("tpb", F.coalesce(F.last_value(known, ignoreNulls=True).over(before()), F.lit(default)))


def span_at(name: Column, c: TokenizerConfig, rest: bool = False) -> Column:
    """Ticks of a span at the row's ``tpb``."""
    g, out = Grids(c), None
    for t in sorted(set(g.ticks_per_beat.values()) | {g.positions_per_beat}):
        case = ticks_of(name, g.tick_table(t, rest))
        out = F.when(F.col("tpb") == t, case) if out is None else out.when(F.col("tpb") == t, case)
    return out


def with_program(rows: DataFrame, c: TokenizerConfig) -> DataFrame:
    """``program``: of the last program token before; in streams of their own, of the stream's first one."""
    own = F.when(F.col("type") == "Program", F.col("value").cast("int"))
    if c.one_token_stream_for_programs:
        return rows.withColumn("program", F.coalesce(F.last_value(own, ignoreNulls=True).over(before()), F.lit(0)))
    whole = Window.partitionBy(*SEQ).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("program", F.coalesce(F.first_value(own, ignoreNulls=True).over(whole), F.lit(0)))


def with_pitch(rows: DataFrame, c: TokenizerConfig) -> DataFrame:
    """``sound``: the absolute pitch of note tokens.

    An interval adds to the pitch of the note (chord interval) or of the onset (time interval)
    before, within its program: so pitches are running sums since the last absolute one.
    """
    value = F.when(F.col("type").isin(list(PITCHED)), F.col("value").cast("int"))
    if not c.use_pitch_intervals:
        return rows.withColumn("sound", value)
    line = Window.partitionBy(*SEQ, "program").orderBy("pos")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    absolute = F.col("type").isin("Pitch", "PitchDrum", "NoteOn", "DrumOn")
    rows = rows.withColumn("group", F.sum(F.when(absolute, 1).otherwise(0)).over(so_far))
    # Onset pitches: the absolute one, moved by every time interval of its group.
    in_group = Window.partitionBy(*SEQ, "program", "group").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("onset", F.sum(F.when(absolute | (F.col("type") == "PitchIntervalTime"), value)).over(in_group))
    rows = rows.withColumn("onsets", F.sum(F.when(absolute | (F.col("type") == "PitchIntervalTime"), 1).otherwise(0)).over(in_group))
    in_onset = Window.partitionBy(*SEQ, "program", "group", "onsets").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = F.sum(F.when(F.col("type") == "PitchIntervalChord", value).otherwise(0)).over(in_onset)
    return rows.withColumn("sound", F.when(value.isNotNull(), F.col("onset") + steps)).drop("group", "onset", "onsets")


def in_range(c: TokenizerConfig) -> Column:
    """Decoders take the upper end of the range too, and test drums against the melodic range."""
    return (F.col("sound") >= c.pitch_range[0]) & (F.col("sound") <= c.pitch_range[1])


def complete_notes(rows: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Notes whose velocity and duration follow their pitch; incomplete ones are skipped."""
    w, at = by_place(), 1
    found = rows
    velocity = F.lit(DEFAULT_VELOCITY)
    good = F.col("type").isin("Pitch", "PitchDrum", "PitchIntervalTime", "PitchIntervalChord") & in_range(c)
    if c.use_velocities:
        found = found.withColumns({"t1": F.lead("type", at).over(w), "v1": F.lead("value", at).over(w)})
        good, velocity, at = good & (F.col("t1") == "Velocity"), F.when(F.col("t1") == "Velocity", F.col("v1")).cast("int"), at + 1
    lasting = F.col("program").isin(list(c.use_note_duration_programs)) if len(c.use_note_duration_programs) < 129 else F.lit(True)
    default = (F.col("tpb") * c.default_note_duration).cast("long")
    if c.uses_durations:
        found = found.withColumns({"t2": F.lead("type", at).over(w), "v2": F.lead("value", at).over(w)})
        length = F.when(lasting, F.when(F.col("t2") == "Duration", span_at(F.col("v2"), c))).otherwise(default)
    else:
        length = default
    return found.select(*SEQ, "pos", "program", F.col("tick").alias("time"), length.alias("duration"), F.col("sound").cast("int").alias("pitch"), velocity.alias("velocity"), good.alias("good")).where(
        "good and duration is not null"
    ).select(*SEQ, "program", "time", "duration", "pitch", "velocity")


def globals_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tempos and time signatures, from stream 0 only."""
    first = rows.where("seq_idx = 0")
    tempos = first.where("type = 'Tempo'").select("score_id", F.col("pos").cast("int").alias("seq"), F.col("tick").alias("time"), qpm_to_mspq(F.col("value").cast("double")).alias("mspq"))
    part = lambda i: F.substring_index("value", "/", i).cast("int")
    signatures = first.where("type = 'TimeSig'").select("score_id", F.col("pos").cast("int").alias("seq"), F.col("tick").alias("time"), part(1).alias("num"), part(-1).alias("den"))
    return tempos, signatures.dropDuplicates(["score_id", "time", "num", "den"])


def pedals_of(rows: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Pedals with a duration token, or from the first ``Pedal`` to the next ``PedalOff`` of a program."""
    rows = rows.withColumn("pedal", F.when(F.col("type").isin("Pedal", "PedalOff"), F.col("value").cast("int") if c.use_programs else F.col("program")))
    if c.sustain_pedal_duration:
        w = by_place()
        length = F.when(F.lead("type").over(w) == "Duration", span_at(F.lead("value").over(w), c))
        out = rows.withColumn("duration", length).where("type = 'Pedal' and duration is not null")
        return out.select(*SEQ, F.col("pedal").alias("program"), F.col("tick").alias("time"), "duration")
    w = Window.partitionBy(*SEQ, "pedal").orderBy("pos")
    marks = rows.where("type in ('Pedal', 'PedalOff')")
    offs = F.sum(F.when(F.col("type") == "PedalOff", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("island", F.coalesce(offs, F.lit(0)))
    on, off = (F.min(F.when(F.col("type") == kind, F.col("tick"))) for kind in ("Pedal", "PedalOff"))
    out = marks.groupBy(*SEQ, "pedal", "island").agg(on.alias("time"), off.alias("end")).where("time is not null and end is not null")
    return out.select(*SEQ, F.col("pedal").alias("program"), "time", (F.col("end") - F.col("time")).alias("duration"))


def bends_of(rows: DataFrame) -> DataFrame:
    return rows.where("type = 'PitchBend'").select(*SEQ, "program", F.col("tick").alias("time"), F.col("value").cast("int").alias("value"))


def decoded(rows: DataFrame, c: TokenizerConfig, notes: DataFrame | None = None) -> Decoded:
    """Everything from token rows with ``tick``, ``tpb``, ``program`` and ``sound``."""
    tempos, signatures = globals_of(rows)
    return Decoded(complete_notes(rows, c) if notes is None else notes, tempos, signatures, pedals_of(rows, c), bends_of(rows))


def shifted(tokens: DataFrame, c: TokenizerConfig) -> DataFrame:
    """``tick`` as the running sum of the time shifts."""
    rows = with_ticks_per_beat(parsed(tokens), c)
    step = F.when(F.col("type") == "TimeShift", span_at(F.col("value"), c))
    return rows.withColumn("tick", F.coalesce(F.sum(F.coalesce(step, F.lit(0))).over(before()), F.lit(0)))


def with_sounding(rows: DataFrame, c: TokenizerConfig, marking: tuple[str, ...]) -> DataFrame:
    """``until``: the latest tick that a token keeps sounding, on a row's own ``clock``; null for others."""
    w, offset = by_place(), 1 + c.use_velocities
    length = F.when(F.lead("type", offset).over(w) == "Duration", F.coalesce(span_at(F.lead("value", offset).over(w), c), F.lit(0)))
    rows = rows.withColumn("length", F.when(F.col("type").isin(list(PITCHED)), length))
    until = F.when(F.col("length").isNotNull(), F.col("clock") + F.col("length")).when(F.col("type").isin(list(marking)), F.col("clock"))
    return rows.withColumn("until", until).drop("length")


def rested_shifts(tokens: DataFrame, c: TokenizerConfig, marking: tuple[str, ...]) -> DataFrame:
    """``tick`` of time shifts and of rests that start from the latest note end.

    ``clock`` sums up both as if no note were sounding at a rest; the real clock runs ahead of it by a lift, which a
    rest raises by what the latest end since the rest before is ahead of ``clock``.  Ends before that rest don't count:
    the lift is what they were ahead of an earlier clock, at least.  All windows are of one order, over rows made once.
    """
    rows = with_ticks_per_beat(parsed(tokens), c)
    rest = F.col("type") == "Rest"
    step = F.when(F.col("type") == "TimeShift", span_at(F.col("value"), c)).when(rest, span_at(F.col("value"), c, rest=True))
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0)).cast("long"))
    rows = rows.withColumns({"clock": F.sum("step").over(before()), "n": F.sum(F.when(rest, 1).otherwise(0)).over(before()).cast("long")})
    rows = with_sounding(rows, c, marking)
    # The latest end since the last rest: of the largest number of rests the largest end.
    rows = rows.withColumn("latest", F.max(F.struct("n", "until")).over(before()))
    rows = rows.withColumn("latest", F.lag("latest.until").over(by_place()))
    ahead = F.when(rest, F.greatest(F.col("latest") - (F.col("clock") - F.col("step")), F.lit(0).cast("long")))
    rows = rows.withColumn("lift", F.coalesce(F.sum(ahead).over(before()), F.lit(0)))
    return rows.withColumn("tick", F.col("clock") + F.col("lift")).drop("clock", "step", "n", "lift", "until", "latest")


def rested(tokens: DataFrame, c: TokenizerConfig, marking: tuple[str, ...], bars: bool) -> DataFrame:
    """``tick`` where rests start from the latest note end and move bars: a fold over each stream."""
    g = Grids(c)
    of = g.ticks_per_beat
    tables = {t: (dict(zip(x.names, x.ticks, strict=True)), dict(zip(y.names, y.ticks, strict=True))) for t in set(of.values()) | {g.positions_per_beat} for x, y in [(g.tick_table(t), g.tick_table(t, rest=True))]}
    offset = 1 + c.use_velocities

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        tpb = of.get(4, g.positions_per_beat)
        per_bar, tick, end, bar, at_bar = 4 * tpb, 0, 0, -1, 0
        sig_bar, sig_tick = 0, 0
        ticks, tpbs = [], []
        kinds, values = rows["type"].tolist(), rows["value"].tolist()
        for i, (kind, value) in enumerate(zip(kinds, values, strict=True)):
            names, rests = tables[tpb]
            if kind == "TimeShift":
                tick += names.get(value, 0)
            elif kind == "Rest":
                tick = max(tick, end) + rests.get(value, 0)
                if bars:
                    real = sig_bar + (tick - sig_tick) // per_bar
                    if real > bar:
                        bar = max(bar, 0)
                        at_bar += (real - bar) * per_bar
                        bar = real
            elif kind == "Bar" and value != "End":
                bar += 1
                at_bar = at_bar + per_bar if bar > 0 else 0
                tick = at_bar
            elif kind == "Position":
                tick = at_bar + int(value) * max(tpb // g.positions_per_beat, 1)
            elif kind == "TimeSig":
                num, den = map(int, value.split("/"))
                sig_bar, sig_tick = sig_bar + (tick - sig_tick) // per_bar, tick
                tpb = of[den]
                per_bar = tpb * num
            if kind in PITCHED and i + offset < len(kinds) and kinds[i + offset] == "Duration":
                end = max(end, tick + tables[tpb][0].get(values[i + offset], 0))
            elif kind in marking:
                end = max(end, tick)
            ticks.append(tick)
            tpbs.append(tpb)
        return rows.assign(tick=ticks, tpb=tpbs)

    return parsed(tokens).groupBy(*SEQ).applyInPandas(fold, "score_id long, seq_idx int, pos long, token string, type string, value string, tick long, tpb int")


def in_bars(tokens: DataFrame, c: TokenizerConfig) -> DataFrame:
    """``tick`` from bars and positions (no rests): a bar starts where those before it end."""
    g = Grids(c)
    rows = parsed(tokens)
    rows = with_ticks_per_beat(rows, c)
    is_bar = (F.col("type") == "Bar") & (F.col("value") != "End")
    if c.use_time_signatures:
        w = by_place()
        # The signature of a bar follows its bar token.
        num = F.when(F.lead("type").over(w) == "TimeSig", F.substring_index(F.lead("value").over(w), "/", 1).cast("int"))
        den = F.when(F.lead("type").over(w) == "TimeSig", F.substring_index(F.lead("value").over(w), "/", -1).cast("int"))
        length = num * F.element_at(F.create_map(*(F.lit(x) for kv in g.ticks_per_beat.items() for x in kv)), den)
        rows = rows.withColumn("length", F.when(is_bar, length))
        rows = rows.withColumn("length", F.when(is_bar, F.coalesce("length", F.last_value("length", ignoreNulls=True).over(before()), F.lit(4 * g.ticks_per_beat.get(4, g.positions_per_beat)))))
    else:
        rows = rows.withColumn("length", F.when(is_bar, F.lit(4 * g.positions_per_beat)))
    total = F.sum(F.coalesce("length", F.lit(0))).over(before())
    rows = rows.withColumn("at_bar", F.coalesce(total - F.last_value("length", ignoreNulls=True).over(before()), F.lit(0)))
    rows = rows.withColumn("bars", F.sum(F.when(is_bar, 1).otherwise(0)).over(before()))
    in_bar = Window.partitionBy(*SEQ, "bars").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col("type") == "Position", F.col("value").cast("int") * F.greatest(quotient(F.col("tpb"), g.positions_per_beat), F.lit(1)))
    rows = rows.withColumn("tick", F.col("at_bar") + F.coalesce(F.last_value(place, ignoreNulls=True).over(in_bar), F.lit(0)))
    return rows.drop("length", "at_bar", "bars")


def tsd(tokens: DataFrame, c: TokenizerConfig) -> Decoded:
    marking = ("Program", "Tempo", "TimeSig", "Pedal", "PedalOff", "PitchBend", "Chord")
    rows = rested_shifts(tokens, c, marking) if c.use_rests else shifted(tokens, c)
    return decoded(with_pitch(with_program(rows, c), c), c)


def remi(tokens: DataFrame, c: TokenizerConfig) -> Decoded:
    marking = ("Program", "Tempo", "TimeSig", "Pedal", "PedalOff", "PitchBend", "Chord")
    rows = rested(tokens, c, marking, bars=True) if c.use_rests else in_bars(tokens, c)
    return decoded(with_pitch(with_program(rows, c), c), c)


def structured(tokens: DataFrame, c: TokenizerConfig) -> Decoded:
    return decoded(with_pitch(with_program(shifted(tokens, c), c), c), c)


def note_pairs(rows: DataFrame, longest: Column | None = None) -> DataFrame:
    """Notes from on and off marks: the k-th off of a pitch that has an open note ends its k-th on.

    ``rows`` has score_id, seq_idx, program, pitch, pos, tick, is_on, velocity.  Offs without an
    open note are ignored; ons without an off last ``longest`` ticks, or are left out without it.
    """
    w = Window.partitionBy(*SEQ, "program", "pitch").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # The balance of ons and offs, lifted whenever it would fall below zero: such offs are invalid.
    step = F.when(F.col("is_on"), 1).otherwise(-1)
    rows = rows.withColumn("sum", F.sum(step).over(so_far))
    rows = rows.withColumn("lowest", F.least(F.min("sum").over(so_far), F.lit(0)))
    valid = F.col("is_on") | (F.col("lowest") == F.coalesce(F.lag("lowest").over(w), F.lit(0)))
    rows = rows.withColumn("valid", valid).where("valid")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*SEQ, "program", "pitch", "is_on").orderBy("pos")))
    keys = [*SEQ, "program", "pitch", "k"]
    ends = rows.where("not is_on").select(*keys, F.col("tick").alias("end"))
    out = rows.where("is_on").join(ends, keys, "inner" if longest is None else "left")
    length = F.col("end") - F.col("tick")
    if longest is not None:
        length = F.least(F.coalesce(length, longest), longest)
    return out.select(*SEQ, "program", F.col("tick").alias("time"), length.alias("duration"), "pitch", "velocity")


def midilike(tokens: DataFrame, c: TokenizerConfig) -> Decoded:
    """Time shifts and rests both move the clock; notes are paired first in, first out."""
    rows = with_ticks_per_beat(parsed(tokens), c)
    step = F.when(F.col("type") == "TimeShift", span_at(F.col("value"), c)).when(F.col("type") == "Rest", span_at(F.col("value"), c, rest=True) if c.use_rests else F.lit(0))
    rows = rows.withColumn("tick", F.sum(F.coalesce(step, F.lit(0))).over(before()))
    rows = with_pitch(with_program(rows, c), c)
    w = by_place()
    velocity = F.when(F.lead("type").over(w) == "Velocity", F.lead("value").over(w).cast("int")) if c.use_velocities else F.lit(DEFAULT_VELOCITY)
    is_on = F.col("type").isin(list(PITCHED))
    marks = rows.withColumns({"velocity": velocity, "is_on": is_on, "pitch": F.coalesce("sound", F.when(F.col("type").isin("NoteOff", "DrumOff"), F.col("value").cast("int")))})
    lo, hi = c.pitch_range
    marks = marks.where(F.col("pitch").isNotNull() & F.col("pitch").between(lo, hi) & (~F.col("is_on") | F.col("velocity").isNotNull()))
    longest = c.additional_params.get("max_duration")
    limit = None
    if longest:
        beats, pos, res = longest
        limit = quotient((F.lit(beats * res + pos)) * F.col("tpb"), res)
    return decoded(rows, c, note_pairs(marks, limit))


def compound_rows(rows: DataFrame, places: dict[str, int]) -> DataFrame:
    """Compound tokens with the value of each named place in a column of its own."""
    value = {name: token_value(F.get(F.col("tokens"), F.lit(i))) for name, i in places.items()}
    return rows.select(*SEQ, "pos", token_type(F.get(F.col("tokens"), F.lit(0))).alias("type"), *(v.alias(n) for n, v in value.items()))


def octuple_places(c: TokenizerConfig) -> dict[str, int]:
    used = [("velocity", c.use_velocities), ("length", c.uses_durations), ("program", c.use_programs), ("tempo", c.use_tempos), ("signature", c.use_time_signatures)]
    return {n: i for i, n in enumerate(["pitch", "position", "bar", *(n for n, on in used if on)])}


def octuple(rows: DataFrame, c: TokenizerConfig, sections: DataFrame | None = None) -> Decoded:
    """Every row holds its own bar and position; signatures change at the bar where they first differ.

    Bars without notes before that one aren't told by the tokens; ``sections`` (score_id, sections) of the score tell them.
    """
    g, places = Grids(c), octuple_places(c)
    out = compound_rows(rows, places)
    whole = F.lit(True)
    for n in ("position", "bar", "velocity", "length", "program"):
        if n in places:
            whole = whole & (F.col(n) != "None")
    out = out.where(whole).withColumns({"bar": F.col("bar").cast("long"), "position": F.col("position").cast("long")})
    out = out.withColumn("program", F.col("program").cast("int") if c.use_programs else F.lit(0))
    if c.use_time_signatures:
        out = _signature_sections(out, g) if sections is None else _known_sections(out, sections, g)
    else:
        out = out.withColumns({"tpb": F.lit(g.positions_per_beat), "tick": F.col("bar") * 4 * g.positions_per_beat + F.col("position")})
    length = span_at(F.col("length"), c) if c.uses_durations else (F.col("tpb") * c.default_note_duration).cast("long")
    velocity = F.col("velocity").cast("int") if c.use_velocities else F.lit(DEFAULT_VELOCITY)
    notes = out.select(*SEQ, "program", F.col("tick").alias("time"), length.alias("duration"), F.col("pitch").cast("int").alias("pitch"), velocity.alias("velocity"))
    changed = lambda name: F.coalesce(F.lag(name).over(by_place()) != F.col(name), F.lit(True))
    spark = rows.sparkSession
    if c.use_tempos:
        tempos = out.where("seq_idx = 0").withColumn("new", changed("tempo")).where("new")
        tempos = tempos.select("score_id", F.col("pos").cast("int").alias("seq"), F.col("tick").alias("time"), qpm_to_mspq(F.col("tempo").cast("double")).alias("mspq"))
    else:
        tempos = spark.createDataFrame([], "score_id long, seq int, time long, mspq double")
    if c.use_time_signatures:
        signatures = out.where("seq_idx = 0").select("score_id", F.col("section").cast("int").alias("seq"), F.col("sig_tick").alias("time"), "num", "den").distinct()
    else:
        signatures = spark.createDataFrame([], "score_id long, seq int, time long, num int, den int")
    empty = spark.createDataFrame([], "score_id long, seq_idx int, program int, time long, duration long")
    bends = spark.createDataFrame([], "score_id long, seq_idx int, program int, time long, value int")
    return Decoded(notes, tempos, signatures, empty, bends)


def _signature_sections(rows: DataFrame, g: Grids) -> DataFrame:
    """``tick``, ``tpb`` and the section's signature of rows with ``bar``, ``position`` and ``signature``."""
    w = by_place()
    new = F.coalesce(F.lag("signature").over(w) != F.col("signature"), F.lit(True))
    rows = rows.withColumn("section", F.sum(F.when(new, 1).otherwise(0)).over(before()))
    part = lambda i: F.substring_index("signature", "/", i).cast("int")
    of = F.create_map(*(F.lit(x) for kv in g.ticks_per_beat.items() for x in kv))
    rows = rows.withColumns({"num": part(1), "den": part(-1)}).withColumn("tpb", F.element_at(of, F.col("den")))
    starts = rows.groupBy(*SEQ, "section").agg(F.min("bar").alias("sig_bar"), F.first("num").alias("n"), F.first("tpb").alias("t"))
    starts = starts.withColumn("sig_bar", F.when(F.col("section") == 1, 0).otherwise(F.col("sig_bar")))
    by_section = Window.partitionBy(*SEQ).orderBy("section")
    length = (F.lead("sig_bar").over(by_section) - F.col("sig_bar")) * F.col("n") * F.col("t")
    starts = starts.withColumn("sig_tick", F.coalesce(F.sum(length).over(by_section.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*SEQ, "section", "sig_bar", "sig_tick")
    rows = rows.join(starts, [*SEQ, "section"])
    step = F.greatest(quotient(F.col("tpb"), g.positions_per_beat), F.lit(1))
    return rows.withColumn("tick", F.col("sig_tick") + (F.col("bar") - F.col("sig_bar")) * F.col("num") * F.col("tpb") + F.col("position") * step)


def _known_sections(rows: DataFrame, sections: DataFrame, g: Grids) -> DataFrame:
    """As :func:`_signature_sections`, with the bars at which the score's ``sections`` start."""
    of = F.create_map(*(F.lit(x) for kv in g.ticks_per_beat.items() for x in kv))

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        tick = F.coalesce(last.tick + (s.first_bar - last.bar) * last.num * last.tpb, F.lit(0).cast("long"))
        return F.array_append(out, F.struct(s.first_bar.alias("bar"), tick.alias("tick"), s.num.alias("num"), s.den.alias("den"), F.element_at(of, s.den).alias("tpb")))

    none = F.expr("cast(array() as array<struct<bar:bigint,tick:bigint,num:int,den:int,tpb:int>>)")
    rows = rows.join(sections.select("score_id", F.aggregate("sections", none, step).alias("known")), "score_id")
    rows = rows.withColumn("section", last_not_after("known", lambda s: s.bar, F.col("bar")))
    s = F.get("known", F.col("section"))
    rows = rows.withColumns({"sig_bar": s.bar, "sig_tick": s.tick, "num": s.num, "den": s.den, "tpb": s.tpb}).drop("known")
    wide = F.greatest(quotient(F.col("tpb"), g.positions_per_beat), F.lit(1))
    return rows.withColumn("tick", F.col("sig_tick") + (F.col("bar") - F.col("sig_bar")) * F.col("num") * F.col("tpb") + F.col("position") * wide)


def _only_notes(notes: DataFrame, tempos: DataFrame | None = None, signatures: DataFrame | None = None) -> Decoded:
    spark = notes.sparkSession
    return Decoded(
        notes,
        tempos if tempos is not None else spark.createDataFrame([], "score_id long, seq int, time long, mspq double"),
        signatures if signatures is not None else spark.createDataFrame([], "score_id long, seq int, time long, num int, den int"),
        spark.createDataFrame([], "score_id long, seq_idx int, program int, time long, duration long"),
        spark.createDataFrame([], "score_id long, seq_idx int, program int, time long, value int"),
    )


def cpword(rows: DataFrame, c: TokenizerConfig) -> Decoded:
    """Metric rows as bar, position and rest tokens, note rows as theirs; then as REMI."""
    used = [c.use_velocities, c.uses_durations, c.use_programs, c.use_chords, c.use_rests, c.use_tempos, c.use_time_signatures]
    names = ["velocity", "length", "program", "chord", "rest", "tempo", "signature"]
    place = {n: 3 + sum(used[:i]) for i, n in enumerate(names) if used[i]}
    at = lambda i: F.get(F.col("tokens"), F.lit(i))
    note = at(0) == "Family_Note"
    needed = [2] + [place[n] for n in ("velocity", "length", "program") if n in place]
    complete = note
    for i in needed:
        complete = complete & (token_value(at(i)) != "None")
    shown = lambda i: F.when(at(i) != "Ignore_None", at(i))
    metric = [shown(1), *(shown(place[n]) for n in ("rest", "tempo", "signature") if n in place)]
    sound = [at(place["program"])] if "program" in place else []
    sound += [at(2), *(at(place[n]) for n in ("velocity", "length") if n in place)]
    flat = F.when(complete, F.array(*sound)).when(~note, F.filter(F.array(*metric), lambda x: x.isNotNull()))
    long = rows.select(*SEQ, "pos", F.posexplode(flat).alias("i", "token"))
    long = long.select(*SEQ, (F.col("pos") * 16 + F.col("i")).alias("pos"), "token")
    out = remi(long, c.with_(one_token_stream_for_programs=c.use_programs))
    same = Window.partitionBy("score_id").orderBy("seq")
    tempos = out.tempos.withColumn("new", F.coalesce(F.lag("mspq").over(same) != F.col("mspq"), F.lit(True))).where("new").drop("new")
    return Decoded(out.notes, tempos, out.time_signatures, out.pedals, out.pitch_bends)


def mumidi(rows: DataFrame, c: TokenizerConfig) -> Decoded:
    """Bars and positions stand in every row; the program in the last program row."""
    g = Grids(c)
    after = 3 + c.use_tempos
    places = {"value": 0, "bar": 1, "position": 2} | ({"tempo": 3} if c.use_tempos else {})
    places |= {"velocity": after} if c.use_velocities else {}
    places |= {"length": after + c.use_velocities} if c.uses_durations else {}
    out = compound_rows(rows, places)
    out = out.withColumn("program", F.coalesce(F.last_value(F.when(F.col("type") == "Program", F.col("value").cast("int")), ignoreNulls=True).over(before()), F.lit(0)))
    tick = F.col("bar").cast("long") * 4 * g.positions_per_beat + F.when(F.col("position") == "None", 0).otherwise(F.expr("try_cast(position as bigint)"))
    out = out.withColumns({"tick": tick, "tpb": F.lit(g.positions_per_beat)})
    length = span_at(F.col("length"), c) if c.uses_durations else F.lit(int(g.positions_per_beat * c.default_note_duration)).cast("long")
    velocity = F.col("velocity").cast("int") if c.use_velocities else F.lit(DEFAULT_VELOCITY)
    notes = out.where(F.col("type").isin("Pitch", "PitchDrum")).select(*SEQ, "program", F.col("tick").alias("time"), length.alias("duration"), F.col("value").cast("int").alias("pitch"), velocity.alias("velocity"))
    tempos = None
    if c.use_tempos:
        new = F.coalesce(F.lag("tempo").over(by_place()) != F.col("tempo"), F.lit(True))
        tempos = out.withColumn("new", new).where("new").select("score_id", F.col("pos").cast("int").alias("seq"), F.col("tick").alias("time"), qpm_to_mspq(F.col("tempo").cast("double")).alias("mspq"))
    return _only_notes(notes, tempos)


def pertok(tokens: DataFrame, c: TokenizerConfig) -> Decoded:
    """Bars are absolute, shifts and positions run within them; microtiming moves the note."""
    from .pertok import PerTokGrid

    grid = PerTokGrid.of(c)
    table = TickTable(tuple(".".join(map(str, s)) for s in grid.durations), tuple(grid.ticks))
    rows = parsed(tokens).withColumn("bar", F.sum(F.when(F.col("type") == "Bar", 1).otherwise(0)).over(before()))
    in_bar = Window.partitionBy(*SEQ, "bar").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    if grid.use_positions:
        moved = F.last_value(F.when(F.col("type") == "Position", F.col("value").cast("long")), ignoreNulls=True).over(in_bar)
    else:
        moved = F.sum(F.when(F.col("type") == "TimeShift", ticks_of(F.col("value"), table))).over(in_bar)
    rows = rows.withColumn("tick", F.col("bar") * 4 * grid.tpq + F.coalesce(moved, F.lit(0)))
    w, at = by_place(), 1
    micro = F.lit(0)
    if grid.use_microtiming:
        micro, at = F.when(F.lead("type").over(w) == "MicroTiming", F.lead("value").over(w).cast("int")), 2
    velocity = F.lead("value", at).over(w).cast("int") if c.use_velocities else F.lit(DEFAULT_VELOCITY)
    length = F.when(F.lead("type", at + c.use_velocities).over(w) == "Duration", ticks_of(F.lead("value", at + c.use_velocities).over(w), table))
    rows = with_program(rows, c)
    pitched = F.col("type").isin("Pitch", "PitchDrum")
    out = rows.select(*SEQ, "program", (F.col("tick") + F.coalesce(micro, F.lit(0))).alias("time"), length.alias("duration"), F.when(pitched, F.col("value").cast("int")).alias("pitch"), F.when(pitched, velocity).alias("velocity"))
    return _only_notes(out.where("pitch is not null and duration is not null"))
