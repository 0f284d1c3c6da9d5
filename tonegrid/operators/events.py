"""Event rows of preprocessed scores, with a total order in place of append order.

An event is (score_id, seq_idx, time, cls, track, src, seq, sub, type, value, program, note_end).
``seq_idx`` is the token stream: 0 for all with one stream per score, else the track's number.
Within a stream events are ordered by (time, cls, track, src, seq, sub): global events have track
-1; ``src`` is 0 time signature, 1 tempo, 2 attribute control, 3 pedal, 4 bend, 5 chord, 6 note; ``seq`` numbers the
rows of a source, ``sub`` the events of a row.

Events of a row at one tick follow each other, so they can stay together as a run: a row with ``tokens`` in place of
``value``, the ``type`` and ``sub`` of its first event, the ``note_end`` of its note, and the ``section`` that a time signature opens.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions import by_value, lookup, token, two_decimals
from ..grids import Grids
from .chords import detect_chords
from .scores import SECTION, ScoreTables, section_at, with_sections

ORDER = ["time", "cls", "track", "src", "seq", "sub"]
NO_TOKENS = "cast(array() as array<string>)"
SCHEMA = ["score_id", "seq_idx", *ORDER, "type", "value", "program", "note_end"]


def stream_order() -> Window:
    return Window.partitionBy("score_id", "seq_idx").orderBy(*ORDER)


def duration_name(ticks: Column, tpb: Column, c: TokenizerConfig) -> Column:
    """``beats.positions.resolution`` of a duration that lies on the grid."""
    g = Grids(c)

    def name(t: int) -> Column:
        table = g.tick_table(t)
        return lookup([table.name_of.get(i) for i in range(table.longest + 1)], ticks, "string")

    return by_value(tpb, g.possible_ticks_per_beat, name)


class _Event(NamedTuple):
    sub: int
    kind: Column | str
    value: Column
    time: str = "time"
    note_end: Column | None = None
    cls: int = 10

    @property
    def fields(self) -> dict[str, Column]:
        kind = F.lit(self.kind) if isinstance(self.kind, str) else self.kind
        end = F.lit(None) if self.note_end is None else self.note_end
        return {"time": F.col(self.time).cast("long"), "cls": F.lit(self.cls), "sub": F.lit(self.sub), "type": kind, "value": self.value.cast("string"), "note_end": end.cast("long")}


def _run(events: list[tuple[bool | Column, _Event]]) -> dict[str, Column]:
    """Events of one tick; the first one's condition is that of the run."""
    condition, first = events[0]
    names = [(on is True or on is condition, on, token(e.kind, e.value)) for on, e in events]
    if all(always for always, _, _ in names):
        tokens = F.array(*(name for _, _, name in names))
    else:
        tokens = F.concat(*(F.array(name) if always else F.when(on, F.array(name)).otherwise(F.expr(NO_TOKENS)) for always, on, name in names))
    end = next((e.note_end for _, e in events if e.note_end is not None), None)
    fields = first._replace(note_end=end).fields
    return {n: tokens if n == "value" else fields[n] for n in fields}


def _made(rows: DataFrame, src: int, events: list[tuple[bool | Column, _Event]], whole: bool) -> DataFrame:
    """A row per event whose condition holds, or per run of them (``whole``); ``rows`` has score_id, track_idx, program, seq."""
    events = [(on, e) for on, e in events if on is not False]
    if whole:
        runs: dict = {}
        for on, e in events:
            runs.setdefault((e.time, e.cls), []).append((on, e))
        made = [(run[0][0], _run(run)) for run in runs.values()]
    else:
        made = [(on, e.fields) for on, e in events]
    # Rows are multiplied by number, and what the numbers stand for told after that: arrays of structs cost much more.
    nth = F.col("_nth")
    rows = rows.withColumn("_nth", F.explode(F.array(*map(F.lit, range(len(made))))) if len(made) > 1 else F.lit(0))
    if any(isinstance(on, Column) for on, _ in made):
        rows = rows.where(F.coalesce(by_value(nth, range(len(made)), lambda i: F.lit(True) if made[i][0] is True else made[i][0]), F.lit(False)))
    of = lambda n: made[0][1][n] if len(made) == 1 else by_value(nth, range(len(made)), lambda i: made[i][1][n])
    own = {"time": of("time"), "cls": of("cls"), "track": F.col("track_idx"), "src": F.lit(src), "seq": F.col("seq"), "sub": of("sub"), "type": of("type"), "tokens" if whole else "value": of("value")}
    own |= {"program": F.col("program").cast("int"), "note_end": of("note_end")}
    return rows.select("score_id", *(v.alias(n) for n, v in own.items()), *(["section"] if "section" in rows.columns else []))


def pitch_intervals(notes: DataFrame, tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """Notes with ``interval_type`` and ``interval`` where the pitch is told relative to one before (drums never)."""
    w = Window.partitionBy("score_id", "track_idx").orderBy("time", "pitch", "duration", "velocity")
    before, pitch_before = F.lag("time").over(w), F.lag("pitch").over(w)
    rows = with_sections(notes, tables, c).withColumn("reach", section_at(F.col("time")).tpb * c.pitch_intervals_max_time_dist).drop("sections")
    rows = rows.withColumns({"before": before, "pitch_before": pitch_before})
    onset = F.col("before").isNull() | (F.col("before") != F.col("time"))
    opens = onset | (F.abs(F.col("pitch") - F.col("pitch_before")) > c.max_pitch_interval)
    rows = rows.withColumn("opened", F.when(opens, F.col("pitch")))
    rows = rows.withColumn("reference", F.last_value("opened", ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    steps = F.col("pitch") - F.when(onset, F.col("reference")).otherwise(F.col("pitch_before"))
    near = (F.abs(steps) <= c.max_pitch_interval) & (F.col("program") != -1)
    kind = F.when(onset & near & (F.col("time") - F.col("before") <= F.col("reach")), "PitchIntervalTime").when(~onset & near, "PitchIntervalChord")
    rows = rows.withColumn("interval_type", kind).withColumn("interval", F.when(kind.isNotNull(), steps))
    return rows.drop("before", "pitch_before", "opened", "reference", "reach")


def note_events(tables: ScoreTables, c: TokenizerConfig, note_on_off: bool, whole: bool = False) -> DataFrame:
    order = Window.partitionBy("score_id", "track_idx").orderBy("time", "pitch", "duration", "velocity")
    notes = pitch_intervals(tables.notes, tables, c) if c.use_pitch_intervals else tables.notes
    notes = notes.withColumns({"seq": F.row_number().over(order).cast("long"), "end": F.col("time") + F.col("duration")})
    inline = c.use_programs and not c.program_changes
    drum = (F.col("program") == -1) if c.use_pitchdrum_tokens else F.lit(False)
    on, off = ("NoteOn", "NoteOff") if note_on_off else ("Pitch", None)
    drum_on, drum_off = ("DrumOn", "DrumOff") if note_on_off else ("PitchDrum", None)
    kind, value = F.when(drum, drum_on).otherwise(on), F.col("pitch")
    if c.use_pitch_intervals:
        kind, value = F.coalesce("interval_type", kind), F.coalesce("interval", value)
    lasting = F.col("program").isin(list(c.use_note_duration_programs)) if len(c.use_note_duration_programs) < 129 else True
    end = F.col("end")
    events: list = [(inline, _Event(0, "Program", F.col("program"), note_end=end)), (True, _Event(1, kind, value, note_end=end)), (c.use_velocities, _Event(2, "Velocity", F.col("velocity")))]
    if c.uses_durations and note_on_off:
        events += [(lasting if inline else False, _Event(3, "Program", F.col("program"), "end", cls=1)), (lasting, _Event(4, F.when(drum, drum_off).otherwise(off), F.col("pitch"), "end", cls=1))]
    elif c.uses_durations:
        notes = with_tpb(notes, tables, c)
        events.append((lasting, _Event(3, "Duration", duration_name(F.col("duration"), F.col("tpb"), c))))
    return _made(notes, 6, events, whole)


def with_tpb(rows: DataFrame, tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """``rows`` with the ticks per beat at their ``time``, found once for all that use it."""
    return with_sections(rows, tables, c).withColumn("tpb", section_at(F.col("time")).tpb).drop("sections")


def pedal_events(tables: ScoreTables, c: TokenizerConfig, whole: bool = False) -> DataFrame:
    order = Window.partitionBy("score_id", "track_idx").orderBy("time", "duration")
    rows = with_tpb(tables.pedals, tables, c).withColumns({"seq": F.row_number().over(order).cast("long"), "end": F.col("time") + F.col("duration")})
    value = F.col("program") if c.use_programs else F.lit(0)
    length = duration_name(F.col("duration"), F.col("tpb"), c)
    return _made(
        rows,
        3,
        [
            (True, _Event(0, "Pedal", value, cls=2)),
            (c.sustain_pedal_duration, _Event(1, "Duration", length, cls=2)),
            (not c.sustain_pedal_duration, _Event(1, "PedalOff", value, "end", cls=2)),
        ],
        whole,
    )


def bend_events(tables: ScoreTables, c: TokenizerConfig, whole: bool = False) -> DataFrame:
    order = Window.partitionBy("score_id", "track_idx").orderBy("time", "value")
    rows = tables.pitch_bends.withColumn("seq", F.row_number().over(order).cast("long"))
    inline = c.use_programs and not c.program_changes
    return _made(rows, 4, [(inline, _Event(0, "Program", F.col("program"), cls=3)), (True, _Event(1, "PitchBend", F.col("value"), cls=3))], whole)


def chord_events(tables: ScoreTables, c: TokenizerConfig, whole: bool = False) -> DataFrame:
    inline = c.use_programs and not c.program_changes
    rows = detect_chords(tables, c)
    return _made(rows, 5, [(inline, _Event(0, "Program", F.col("program"))), (True, _Event(1, "Chord", F.col("chord")))], whole)


def control_events(rows: DataFrame, tables: ScoreTables) -> DataFrame:
    """Attribute controls of :func:`.controls.requested`: those of a track before all else, those of a bar at its start."""
    programs = tables.notes.select("score_id", "track_idx", "program").distinct()
    rows = rows.join(programs, ["score_id", "track_idx"])
    cut = F.expr("locate('_', token)")
    values = {"time": F.coalesce("tick", F.lit(0).cast("long")), "cls": F.when(F.col("tick").isNull(), -1).otherwise(10), "track": F.col("track_idx"), "src": F.lit(2), "seq": F.col("control").cast("long")}
    values |= {"sub": F.col("place"), "type": F.expr("substr(token, 1, locate('_', token) - 1)"), "value": F.col("token").substr(cut + 1, F.length("token"))}
    values |= {"program": F.col("program").cast("int"), "note_end": F.lit(None).cast("long")}
    return rows.select("score_id", *(v.alias(n) for n, v in values.items()))


def global_events(tables: ScoreTables, c: TokenizerConfig, whole: bool = False) -> DataFrame | None:
    """Time signatures, then tempos (one set per score)."""
    out = None
    common = {"track_idx": F.lit(-1), "program": F.lit(0), "seq": F.col("seq").cast("long")}
    if c.use_time_signatures and tables.time_signatures is not None:
        s = tables.time_signatures.withColumns(common)
        if whole and tables.sections is not None:
            s = with_sections(s, tables, c).withColumn("section", section_at(F.col("time"))).drop("sections")
        out = _made(s, 0, [(True, _Event(0, "TimeSig", F.concat_ws("/", F.col("num").cast("string"), F.col("den").cast("string")), cls=0))], whole)
    if c.use_tempos and tables.tempos is not None:
        tempos = _made(tables.tempos.withColumns(common), 1, [(True, _Event(0, "Tempo", two_decimals(F.col("qpm")), cls=0))], whole)
        out = tempos if out is None else _both(out, tempos)
    return out


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both; only time signatures have a ``section``."""
    if "section" not in a.columns + b.columns:
        return a.unionByName(b)
    with_section = lambda df: df if "section" in df.columns else df.withColumn("section", F.lit(None).cast(SECTION))
    return with_section(a).unionByName(with_section(b))


def events(tables: ScoreTables, c: TokenizerConfig, note_on_off: bool = False, controls: DataFrame | None = None) -> DataFrame:
    """All events of preprocessed scores, per stream (see the module's text), with attribute controls if given."""
    rows = _streams(tables, c, note_on_off, controls, whole=False)
    if c.program_changes and c.one_token_stream_for_programs:
        rows = with_program_changes(rows)
    return rows.select(*SCHEMA)


def runs(tables: ScoreTables, c: TokenizerConfig, note_on_off: bool = False, controls: DataFrame | None = None) -> DataFrame:
    """The events of :func:`events` in runs, several times fewer rows; where programs change between them, each by itself."""
    if c.program_changes and c.one_token_stream_for_programs:
        return events(tables, c, note_on_off, controls)
    rows = _streams(tables, c, note_on_off, controls, whole=True)
    return rows.select(*("tokens" if n == "value" else n for n in SCHEMA), *(["section"] if "section" in rows.columns else []))


def _streams(tables: ScoreTables, c: TokenizerConfig, note_on_off: bool, controls: DataFrame | None, whole: bool) -> DataFrame:
    tracks = note_events(tables, c, note_on_off, whole)
    if controls is not None:
        made = control_events(controls, tables)
        tracks = tracks.unionByName(made.withColumn("tokens", F.array(token(F.col("type"), F.col("value")))).drop("value") if whole else made)
    if c.use_sustain_pedals and tables.pedals is not None:
        tracks = tracks.unionByName(pedal_events(tables, c, whole))
    if c.use_pitch_bends and tables.pitch_bends is not None:
        tracks = tracks.unionByName(bend_events(tables, c, whole))
    if c.use_chords:
        tracks = tracks.unionByName(chord_events(tables, c, whole))
    shared = global_events(tables, c, whole)
    if c.one_token_stream_for_programs:
        rows = (tracks if shared is None else _both(tracks, shared)).withColumn("seq_idx", F.lit(0))
    else:
        number = F.dense_rank().over(Window.partitionBy("score_id").orderBy("track")).cast("int") - 1
        rows = tracks.withColumn("seq_idx", number)
        if shared is not None:  # every stream has its own copy
            streams = rows.select("score_id", "seq_idx").distinct()
            rows = _both(rows, shared.join(streams, "score_id"))
    if not (note_on_off and c.use_chords):
        rows = rows.withColumn("cls", F.lit(0) if controls is None else F.least("cls", F.lit(0)))
    return rows


def with_program_changes(rows: DataFrame) -> DataFrame:
    """A ``Program`` event before each event whose program differs from that of the last one that counts.

    Time signatures, tempos, pedals and what belongs to a pedal don't count.
    """
    w = stream_order()
    pedal_length = (F.col("type") == "Duration") & (F.lag("type").over(w) == "Pedal")
    counts = ~F.col("type").startswith("AC") & ~F.col("type").isin("TimeSig", "Tempo", "Pedal", "PedalOff") & ~F.coalesce(pedal_length, F.lit(False))
    rows = rows.withColumn("counted", F.when(counts, F.col("program")))
    last = F.last_value("counted", ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("changes", F.coalesce(F.col("counted") != F.coalesce(last, F.lit(-2)), F.lit(False))).drop("counted")
    # Both events come out of their row: a union of two plans would compute the windows twice.
    sub, names = F.col("sub"), ["sub", "type", "value", "note_end"]
    own = F.struct((sub * 2 + 1).alias("sub"), "type", "value", "note_end")
    change = F.struct((sub * 2).alias("sub"), F.lit("Program").alias("type"), F.col("program").cast("string").alias("value"), F.lit(None).cast(rows.schema["note_end"].dataType).alias("note_end"))
    both = F.explode(F.when(F.col("changes"), F.array(change, own)).otherwise(F.array(own))).alias("e")
    kept = [c for c in SCHEMA if c in rows.columns and c not in names]
    return rows.select(*kept, both).select(*kept, *(f"e.{n}" for n in names))
