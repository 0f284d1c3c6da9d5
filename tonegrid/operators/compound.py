"""Octuple, CPWord and MuMIDI: one row of several tokens per note (and per bar, position or program).

Output: (score_id, seq_idx, pos, tokens ARRAY<STRING>, tick); each place of the array has its own
vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions import quotient, token
from ..grids import Grids, two_decimals as name_of_tempo
from .events import ORDER, events, stream_order
from .scores import ScoreTables, bar_at, bar_tick, section_at, with_sections
from .timing import greedy, shortest_rest, timed, unfilled

NO_ROWS = "cast(array() as array<array<string>>)"
IGNORE = "Ignore_None"


def _signature(s: Column) -> Column:
    return F.concat(F.lit("TimeSig_"), s.num.cast("string"), F.lit("/"), s.den.cast("string"))


def _position(time: Column, section: Column, g: Grids) -> Column:
    start = bar_tick(bar_at(time, section), section)
    return quotient(time - start, F.greatest(quotient(section.tpb, g.positions_per_beat), F.lit(1)))


def _tempo_at(rows: DataFrame, g: Grids, order: list[str]) -> DataFrame:
    """``tempo``: the last tempo event's name at or before each event of its stream."""
    w = Window.partitionBy("score_id", "seq_idx").orderBy(*order)
    own = F.when(F.col("type") == "Tempo", F.col("value"))
    last = F.last_value(own, ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("tempo", F.coalesce(last, F.lit(name_of_tempo(g.default_tempo))))


def _laid_out(rows: DataFrame) -> DataFrame:
    """Rows with ``lines`` (an array of compound tokens each) numbered along their stream."""
    rows = rows.withColumn("n", F.size("lines").cast("long"))
    rows = rows.withColumn("first", F.sum("n").over(stream_order()) - F.col("n"))  # before the rows are exploded
    out = rows.select("score_id", "seq_idx", F.col("time").alias("tick"), "first", F.posexplode("lines").alias("i", "tokens"))
    return out.select("score_id", "seq_idx", (F.col("first") + F.col("i")).alias("pos"), "tokens", "tick")


def note_rows(tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """Event rows of which those that open a note hold its velocity, duration and program too."""
    rows = events(tables, c)
    w = stream_order()
    ahead = lambda kind, n: F.when(F.lead("type", n).over(w) == kind, F.lead("value", n).over(w))
    rows = rows.withColumns({"velocity": ahead("Velocity", 1), "duration": F.coalesce(ahead("Duration", 2), ahead("Duration", 1))})
    return rows


def octuple(tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    g = Grids(c)
    rows = _tempo_at(note_rows(tables, c), g, ORDER)
    rows = with_sections(rows.where(F.col("type").isin("Pitch", "PitchDrum")), tables, c).withColumn("section", section_at(F.col("time")))
    time, section = F.col("time"), F.col("section")
    parts = [token(F.col("type"), F.col("value")), token("Position", _position(time, section, g)), token("Bar", bar_at(time, section))]
    optional = [
        (c.use_velocities, token("Velocity", F.col("velocity"))),
        (c.uses_durations, token("Duration", F.col("duration"))),
        (c.use_programs, token("Program", F.col("program"))),
        (c.use_tempos, token("Tempo", F.col("tempo"))),
        (c.use_time_signatures, _signature(section)),
    ]
    line = F.array(*parts, *(x for on, x in optional if on))
    pos = (F.row_number().over(stream_order()) - 1).cast("long").alias("pos")
    return rows.select("score_id", "seq_idx", pos, line.alias("tokens"), F.col("time").alias("tick"))


def cpword(tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """Rests, bars and a position (with tempo and chord) before the first event of a tick; a row per note."""
    g = Grids(c)
    rows = note_rows(tables, c).where(F.col("type").isin("Pitch", "PitchDrum", "Tempo", "TimeSig", "Chord"))
    rows = timed(rows, tables, c)
    rows = _tempo_at(rows, g, ORDER)
    time, section, tpb = F.col("time"), F.col("section"), F.col("section.tpb")
    signature = F.col("type") == "TimeSig"
    fields = ["velocity", "duration", "program", "chord", "rest", "tempo", "signature"]
    used = [c.use_velocities, c.uses_durations, c.use_programs, c.use_chords, c.use_rests, c.use_tempos, c.use_time_signatures]

    def line(family: str, second: Column | str, third: Column | str, **values: Column) -> Column:
        lit = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.array(F.lit(family), lit(second), lit(third), *(values.get(f, F.lit(IGNORE)) for f, on in zip(fields, used, strict=True) if on))

    moved = F.col("previous").isNull() | (time != F.col("previous")) | (F.col("previous_type") == "TimeSig")
    rows = rows.withColumns({"moved": moved, "bar": bar_at(time, section)})
    done = F.coalesce(F.lag("bar").over(stream_order()), F.lit(-1))
    rests = F.expr(NO_ROWS)
    if c.use_rests:
        gap = time - F.col("sounded")
        rows = rows.withColumn("rested", F.col("moved") & (gap > shortest_rest(tpb, g)))
        names = greedy("Rest", gap, tpb, g, rest=True)
        rests = F.when(F.col("rested"), F.transform(names, lambda r: line("Family_Metric", IGNORE, IGNORE, rest=r))).otherwise(rests)
        done = F.when(F.col("rested"), F.greatest(done, bar_at(time - unfilled(gap, tpb, g), section))).otherwise(done)
    rows = rows.withColumn("done", done)
    own = F.concat(F.lit("TimeSig_"), F.col("value"))

    def bar_line(n: Column) -> Column:
        return line("Family_Metric", "Bar_None", IGNORE, signature=F.when(signature & (n == F.col("bar")), own).otherwise(_signature(section)))

    bars = F.when(F.col("bar") > F.col("done"), F.transform(F.sequence(F.col("done") + 1, F.col("bar")), bar_line))
    position = line(
        "Family_Metric",
        token("Position", _position(time, section, g)),
        IGNORE,
        tempo=token("Tempo", F.col("tempo")),
        chord=F.when(F.col("type") == "Chord", token("Chord", F.col("value"))).otherwise(F.lit(IGNORE)),
    )
    note = line(
        "Family_Note",
        IGNORE,
        token(F.col("type"), F.col("value")),
        velocity=token("Velocity", F.col("velocity")),
        duration=F.coalesce(token("Duration", F.col("duration")), F.lit(IGNORE)),
        program=token("Program", F.col("program")),
    )
    nothing = F.expr(NO_ROWS)
    before = F.when(
        F.col("moved"), F.concat(rests, F.coalesce(bars, nothing), F.coalesce(F.when(~signature, F.array(position)), nothing))
    ).otherwise(nothing)
    after = F.when(F.col("type").isin("Pitch", "PitchDrum"), F.array(note)).otherwise(nothing)
    return _laid_out(rows.withColumn("lines", F.concat(before, after)))


def mumidi(tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """Bar, position and program rows before notes ordered by time and program; 4/4 throughout."""
    g = Grids(c)
    rows = note_rows(tables, c)
    rows = _tempo_at(rows, g, ORDER).where(F.col("type").isin("Pitch", "PitchDrum", "Chord"))
    # Chords stand before the notes of their track.
    rows = rows.withColumns({"track": F.col("program"), "cls": F.lit(0)})
    w = stream_order()
    tpq, time = g.positions_per_beat, F.col("time")
    bar, place = quotient(time, 4 * tpq), time % (4 * tpq)
    rows = rows.withColumns({"bar": bar, "place": place, "moved": F.coalesce(F.lag("time").over(w) != time, F.lit(True))})
    rows = rows.withColumns({"done": F.coalesce(F.lag("bar").over(w), F.lit(-1)), "other": F.col("moved") | (F.lag("program").over(w) != F.col("program"))})
    tempo = [token("Tempo", F.col("tempo"))] if c.use_tempos else []
    at = [token("BarPosEnc", F.col("bar")), token("PositionPosEnc", F.col("place")), *tempo]
    bar_line = lambda n: F.array(F.lit("Bar_None"), token("BarPosEnc", n), F.lit("PositionPosEnc_None"), *tempo)
    nothing = F.expr(NO_ROWS)
    bars = F.when(F.col("bar") > F.col("done"), F.transform(F.sequence(F.col("done") + 1, F.col("bar")), bar_line))
    position = F.when(F.col("moved"), F.array(F.array(token("Position", F.col("place")), *at)))
    program = F.when(F.col("other"), F.array(F.array(token("Program", F.col("program")), *at)))
    sound = F.col("type") != "Chord"
    rest = ([F.when(sound, token("Velocity", F.col("velocity")))] if c.use_velocities else []) + ([F.when(sound, token("Duration", F.col("duration")))] if c.uses_durations else [])
    note = F.filter(F.array(token(F.col("type"), F.col("value")), *at, *rest), lambda x: x.isNotNull())
    lines = F.concat(*(F.coalesce(x, nothing) for x in (bars, position, program)), F.array(note))
    return _laid_out(rows.withColumn("lines", lines))
