"""Score tables and their preprocessing onto the grids of a configuration.

Every step is a projection, a filter or a window over one score (or one track of it); all of
them share the hash partitioning by score, so the notes are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions import by_value, clamp, half_even, literal_array, lookup, nearest_bin, qpm_to_mspq, quotient, ticks_per_beat
from ..functions.instruments import instrument_name
from ..grids import Grids
from .asof import last_not_after

SECTION = "struct<start:bigint,end:bigint,num:int,den:int,tpb:bigint,tpbar:bigint,first_bar:bigint>"

#: Notes of a task.  A note becomes five tokens or more, each as wide as the note and sorted several times.
NOTES_OF_TASK = 25_000


@dataclass(frozen=True)
class ScoreTables:
    """Scores in columns; times in ticks of the score's ``tpq``, drums have program -1.

    scores (score_id, tpq); notes (score_id, track_idx, program, time, duration, pitch, velocity);
    tempos (score_id, seq, time, mspq); time_signatures (score_id, seq, time, num, den); pedals
    (score_id, track_idx, program, time, duration); pitch_bends (score_id, track_idx, program,
    time, value); controls (score_id, track_idx, program, time, number, value); tracks (score_id,
    track_idx, program, name).  ``sections`` (score_id, sections) is made by preprocessing with time signatures.
    """

    scores: DataFrame
    notes: DataFrame
    tempos: DataFrame | None = None
    time_signatures: DataFrame | None = None
    pedals: DataFrame | None = None
    pitch_bends: DataFrame | None = None
    sections: DataFrame | None = None
    controls: DataFrame | None = None
    tracks: DataFrame | None = None


def task_count(notes: DataFrame) -> int:
    """Tasks for the notes' one exchange, in proportion to them.

    Left to itself, Spark sizes tasks by the bytes that the exchange writes, a small part of what comes of them.
    """
    return max(notes.sparkSession.sparkContext.defaultParallelism, -(-notes.count() // NOTES_OF_TASK))


def in_pitch_range(c: TokenizerConfig) -> Column:
    """Whether a note's pitch lies in the half-open range of its track."""
    pitch = F.col("pitch")
    within = lambda r: (pitch >= r[0]) & (pitch < r[1])
    if not c.use_pitchdrum_tokens:
        return within(c.pitch_range)
    return F.when(F.col("program") == -1, within(c.drums_pitch_range)).otherwise(within(c.pitch_range))


def snapped_velocity(c: TokenizerConfig) -> Column:
    return lookup(Grids(c).velocity_table, clamp(F.col("velocity"), 0, 127))


def resampled(ticks: Column, new: Column | int, old: Column | int) -> Column:
    """Ticks on another number of ticks per quarter, halves to the even tick."""
    return half_even(ticks.cast("double") * new / old)


def merge_tracks(df: DataFrame) -> DataFrame:
    """Tracks of one program become one, at the place of the first of them."""
    return df.withColumn("track_idx", F.min("track_idx").over(Window.partitionBy("score_id", "program")))


def tracks_of(tables: ScoreTables) -> DataFrame:
    """The ``tracks`` of the tables; where there are none, those of all rows, named after their instruments."""
    if tables.tracks is not None:
        return tables.tracks
    kinds = [t for t in (tables.notes, tables.pedals, tables.pitch_bends, tables.controls) if t is not None]
    rows = reduce(DataFrame.unionByName, (t.select("score_id", "track_idx", "program") for t in kinds)).distinct()
    return rows.withColumn("name", instrument_name(F.col("program")))


def merge_same_program(tables: ScoreTables, effects: bool = True) -> ScoreTables:
    """Tracks of a score with one program become one at the place of the first, named after all of them (``a / b``).

    Notes of all of them are its own; so are, with ``effects``, pedals, bends and controls.  Without, it keeps those of the
    first track only.  Tracks without rows count like any other, and null names as empty.
    """
    tracks = tracks_of(tables)
    group = Window.partitionBy("score_id", "program")
    placed = tracks.select("score_id", "track_idx", "program", F.coalesce("name", F.lit("")).alias("name"), F.min("track_idx").over(group).alias("first"))
    # A score has few tracks of a program, their names stand in one row.
    named = placed.groupBy("score_id", "program", F.col("first").alias("track_idx")).agg(F.array_sort(F.collect_list(F.struct("track_idx", "name"))).alias("all"))
    merged = named.select("score_id", "track_idx", "program", F.array_join(F.transform("all", lambda t: t["name"]), " / ").alias("name"))
    place = placed.select("score_id", "track_idx", "program", "first")

    def moved(df: DataFrame | None, whole: bool) -> DataFrame | None:
        if df is None:
            return None
        rows = df.join(place, ["score_id", "track_idx", "program"])
        rows = rows if whole else rows.where(F.col("track_idx") == F.col("first"))
        return rows.withColumn("track_idx", F.col("first")).select(*df.columns)

    return replace(tables, tracks=merged, notes=moved(tables.notes, True), pedals=moved(tables.pedals, effects), pitch_bends=moved(tables.pitch_bends, effects), controls=moved(tables.controls, effects))


def deduplicate_notes(notes: DataFrame) -> DataFrame:
    """Of the notes of a track with equal time and pitch the shortest stays, then the softest."""
    # One window a track: of its sorted notes those stay that differ from the one before.
    w = Window.partitionBy("score_id", "track_idx").orderBy("time", "pitch", "duration", "velocity")
    rows = notes.withColumns({"nth": F.row_number().over(w), "before": F.lag("time").over(w), "pitch_before": F.lag("pitch").over(w)})
    same = (F.col("nth") > 1) & F.col("time").eqNullSafe(F.col("before")) & F.col("pitch").eqNullSafe(F.col("pitch_before"))
    return rows.where(~same).drop("nth", "before", "pitch_before")


def fix_overlaps(notes: DataFrame) -> DataFrame:
    """Notes that last to or beyond the next onset of their pitch end there."""
    w = Window.partitionBy("score_id", "track_idx", "pitch").orderBy("time", "duration", "velocity")
    ahead = F.lead("time").over(w)
    cut = ahead <= F.col("time") + F.col("duration")
    return notes.withColumn("duration", F.when(cut, ahead - F.col("time")).otherwise(F.col("duration")))


def merge_pedals(pedals: DataFrame) -> DataFrame:
    """Pedals of a track that overlap or touch become one."""
    w = Window.partitionBy("score_id", "track_idx", "program").orderBy("time", "duration")
    end = F.col("time") + F.col("duration")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = pedals.withColumn("fresh", F.when(reach >= F.col("time"), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    merged = islands.groupBy("score_id", "track_idx", "program", "island").agg(F.min("time").alias("time"), F.max(end).alias("end"))
    return merged.select("score_id", "track_idx", "program", "time", (F.col("end") - F.col("time")).alias("duration"))


def pedal_controls(pedals: DataFrame) -> DataFrame:
    """(score_id, track_idx, program, time, number, value): a pedal as control 64 at 127 where it starts and 0 where it ends.

    Rows have no order of their own; at one tick the release of a pedal comes before the next press.
    """
    mark = lambda at, value: F.struct(at.alias("time"), F.lit(64).alias("number"), F.lit(value).alias("value"))
    both = F.array(mark(F.col("time"), 127), mark(F.col("time") + F.col("duration"), 0))
    return pedals.select("score_id", "track_idx", "program", F.explode(both).alias("m")).select("score_id", "track_idx", "program", "m.*")


def with_default_tempo(tempos: DataFrame, scores: DataFrame, qpm: float = 120.0) -> DataFrame:
    """Scores without a tempo at tick 0 get ``qpm`` quarters a minute there."""
    missing = scores.select("score_id").join(tempos.where("time = 0").select("score_id"), "score_id", "left_anti")
    default = missing.select("score_id", F.lit(-1).alias("seq"), F.lit(0).cast("long").alias("time"), F.lit(60e6 / qpm).alias("mspq"))
    return tempos.select("score_id", "seq", "time", "mspq").unionByName(default)


def snap_tempos(tempos: DataFrame, scores: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Tempos on the grid: the last one of a tick, on request no repeats, always one at tick 0."""
    g = Grids(c)
    grid = sorted((int(60e6 / t), t) for t in g.tempos)
    near = F.transform(literal_array([{"m": m, "q": q} for m, q in grid], "struct<m:int,q:double>"), lambda t: F.struct(F.abs(t.m - F.col("mspq").cast("int")).alias("far"), (-t.m).alias("minus"), t.q.alias("q")))
    qpm = F.array_min(near).q
    rows = tempos.select("score_id", "seq", "time", qpm.alias("qpm"))
    w = Window.partitionBy("score_id").orderBy("seq")
    rows = rows.withColumn("later", F.lead("time").over(w)).where("later is null or later <> time").drop("later")
    if c.delete_equal_successive_tempo_changes:
        rows = rows.withColumn("before", F.lag("qpm").over(w)).where("before is null or before <> qpm").drop("before")
        first = F.row_number().over(w) == 1
        rows = rows.withColumn("time", F.when(first & (F.col("qpm") == g.default_tempo), F.lit(0)).otherwise(F.col("time")))
    start = rows.where("time = 0").select("score_id")
    default = scores.select("score_id").join(start, "score_id", "left_anti").select("score_id", F.lit(-1).alias("seq"), F.lit(0).cast("long").alias("time"), F.lit(g.default_tempo).alias("qpm"))
    return rows.unionByName(default).withColumn("mspq", qpm_to_mspq(F.col("qpm")))


def snap_bends(bends: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Pitch bends on the grid; of those of a tick the first with the largest absolute value."""
    rows = bends.withColumn("value", nearest_bin(F.col("value"), Grids(c).pitch_bends, "int"))
    w = Window.partitionBy("score_id", "track_idx", "program", "time").orderBy(F.abs("value").desc(), F.col("value").desc())
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def supported_signatures(signatures: DataFrame, c: TokenizerConfig) -> DataFrame:
    known = [n * 1000 + d for n, d in Grids(c).time_signatures]
    return signatures.where((F.col("num") * 1000 + F.col("den")).isin(known))


def signatures_outside(signatures: DataFrame, scores: DataFrame, c: TokenizerConfig) -> DataFrame:
    """(score_id, outside): whether a score has a time signature that the vocabulary lacks; never if signatures aren't used."""
    if not c.use_time_signatures:
        return scores.select("score_id", F.lit(False).alias("outside"))
    known = supported_signatures(signatures, c).select("score_id", "num", "den").distinct()
    strange = signatures.join(known, ["score_id", "num", "den"], "left_anti").select("score_id").distinct().withColumn("found", F.lit(True))
    return scores.select("score_id").join(strange, "score_id", "left").select("score_id", F.coalesce("found", F.lit(False)).alias("outside"))


def with_default_signature(signatures: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores without a signature at tick 0 get 4/4 there."""
    missing = scores.select("score_id").join(signatures.where("time = 0").select("score_id"), "score_id", "left_anti")
    default = missing.select("score_id", F.lit(-1).alias("seq"), F.lit(0).cast("long").alias("time"), F.lit(4).alias("num"), F.lit(4).alias("den"))
    return signatures.select("score_id", "seq", "time", "num", "den").unionByName(default)


def align_signatures(signatures: DataFrame) -> DataFrame:
    """Time signatures on bar lines (columns score_id, seq, time, num, den, tpq), without repeats.

    Each moves to the next bar line of the one before, so where one lands depends on where that
    landed; of two at one line the later counts.  A score's few rows are folded in one expression.
    """
    kind = "array<struct<time:bigint,num:int,den:int>>"
    last = lambda out: F.try_element_at(out, F.lit(-1))
    same = lambda out, s: F.coalesce((last(out).num == s.num) & (last(out).den == s.den), F.lit(False))

    def step(out: Column, s: Column) -> Column:
        before = last(out)
        bar = quotient(F.col("tpq") * 4, before.den) * before.num
        late = F.greatest(s.time - before.time, F.lit(0))
        time = F.coalesce(before.time + quotient(late + bar - 1, bar) * bar, s.time)
        one = F.array(F.struct(time.cast("long").alias("time"), s.num.alias("num"), s.den.alias("den")))
        shorter = F.slice(out, 1, F.size(out) - 1)
        replaced = F.when(same(shorter, s), shorter).otherwise(F.concat(shorter, one))
        return F.when(same(out, s), out).when(F.coalesce(time == before.time, F.lit(False)), replaced).otherwise(F.concat(out, one))

    rows = F.array_sort(F.collect_list(F.struct("time", "seq", "num", "den")))
    found = signatures.groupBy("score_id").agg(rows.alias("rows"), F.max("tpq").alias("tpq"))
    kept = F.aggregate("rows", F.expr(f"cast(array() as {kind})"), step)
    return found.select("score_id", "tpq", F.posexplode(kept).alias("seq", "s")).select("score_id", "seq", "s.time", "s.num", "s.den", "tpq")


def sections_of(signatures: DataFrame) -> DataFrame:
    """(score_id, sections): the ranges of ticks between aligned time signatures, with their bars."""
    w = Window.partitionBy("score_id").orderBy("time")
    tpb = ticks_per_beat(F.col("tpq"), F.col("den"))
    rows = signatures.select("score_id", "time", "num", "den", tpb.alias("tpb"), (tpb * F.col("num")).alias("tpbar"), F.lead("time").over(w).alias("end"))
    bars = quotient(F.col("end") - F.col("time"), F.col("tpbar"))
    rows = rows.withColumn("first_bar", F.coalesce(F.sum(bars).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    one = F.struct(F.col("time").alias("start"), "end", "num", "den", "tpb", "tpbar", "first_bar").cast(SECTION)
    return rows.groupBy("score_id").agg(F.array_sort(F.collect_list(one)).alias("sections"))


def with_sections(df: DataFrame, tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """``df`` with its score's ``sections``; without time signatures one 4/4 section, and no join."""
    if tables.sections is not None:
        return df.join(tables.sections, "score_id")
    p = c.max_positions_per_beat
    one = F.expr(f"cast(named_struct('start', 0L, 'end', null, 'num', 4, 'den', 4, 'tpb', {p}L, 'tpbar', {4 * p}L, 'first_bar', 0L) as {SECTION})")
    return df.withColumn("sections", F.array(one))


def section_at(time: Column) -> Column:
    """The section of ``sections`` that holds a tick; the only one where there is one (folded to a constant without signatures)."""
    return F.when(F.size("sections") == 1, F.get("sections", F.lit(0))).otherwise(F.get("sections", last_not_after("sections", lambda s: s.start, time)))


def bar_at(time: Column, section: Column) -> Column:
    return section.first_bar + quotient(time - section.start, section.tpbar)


def bar_tick(bar: Column, section: Column) -> Column:
    return section.start + (bar - section.first_bar) * section.tpbar


def snap_durations(notes: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Durations of notes (with ``sections``) on the grid of the section they start in."""
    g = Grids(c)
    # A column of its own: written out in every use, the section would be searched as often.
    notes = notes.withColumn("_tpb", section_at(F.col("time")).tpb)

    def nearest(ticks: int) -> Column:
        t = g.tick_table(ticks)
        return lookup(t.nearest_ticks, clamp(F.col("duration"), 0, t.longest)).cast("long")

    snapped = by_value(F.col("_tpb"), g.possible_ticks_per_beat, nearest)
    with_tokens = F.col("program").isin(list(c.use_note_duration_programs))
    return notes.withColumn("duration", snapped if len(c.use_note_duration_programs) == 129 else F.when(with_tokens, snapped).otherwise(F.col("duration"))).drop("_tpb")


def _merged_factors(p: int) -> Column:
    """From ``sections`` the ranges (start, end, factor) in which positions are equally many ticks apart."""
    kind = "array<struct<start:bigint,end:bigint,factor:bigint>>"
    factor = lambda s: F.greatest(quotient(s.tpb, p), F.lit(1))
    one = lambda start, end, f: F.array(F.struct(start.alias("start"), end.alias("end"), f.cast("long").alias("factor")))

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        same = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)).factor == factor(s))
        return F.when(same, F.concat(F.slice(out, 1, F.size(out) - 1), one(last.start, s.end, factor(s)))).otherwise(F.concat(out, one(s.start, s.end, factor(s))))

    return F.aggregate("sections", F.expr(f"cast(array() as {kind})"), step)


def resnap_over_changes(notes: DataFrame) -> DataFrame:
    """Durations of notes on the grid of their section, ends moved where notes reach into the next one.

    ``notes`` has ``ranges`` (see :func:`_merged_factors`), ``onset`` (the tick before it was snapped) and ``time``.  A range of
    equal grids ends, for a track, at its first note beyond; notes before that reach its tick are ended on a multiple
    of a factor instead.  The factor is that of the first range, from their own on, whose number of notes before
    its end isn't below their tick, else of the last range: a comparison of a count with a tick, which these
    tokenizers make and whose results are kept.  In the last range nothing is moved.
    """
    track = Window.partitionBy("score_id", "track_idx", "program")
    rows = notes.withColumn("k", last_not_after("ranges", lambda r: r.start, F.col("onset")))
    rows = rows.withColumn("factor", F.get("ranges", F.col("k")).factor)
    snapped = half_even(F.col("duration") / F.col("factor")) * F.col("factor")
    rows = rows.withColumn("duration", F.when(snapped == 0, F.col("factor")).otherwise(snapped))
    by_range = track.orderBy("k")
    # Ranges follow the onsets, so that this order serves all windows.
    rows = rows.withColumn("nth", F.row_number().over(track.orderBy("k", "onset", "pitch", "duration", "velocity")) - 1)
    rows = rows.withColumns({
        "known": F.count("*").over(by_range),  # notes of ranges up to the row's own
        "beyond": F.min("time").over(by_range.rangeBetween(1, Window.unboundedFollowing)),
    })
    # One entry per range that has notes; of others the one before counts.
    rows = rows.withColumns({"n": F.count("*").over(track), "last": F.max("time").over(track), "counts": F.collect_set(F.struct("k", "known")).over(track)})
    place = F.sequence(F.col("k"), F.size("ranges") - 1)
    before = lambda j: F.array_max(F.filter("counts", lambda c: c.k <= j)).known
    index = lambda j: F.when(j == F.size("ranges") - 1, F.col("n") - 1).otherwise(F.least(before(j), F.col("n") - 1))
    chosen = F.coalesce(F.get(F.filter(place, lambda j: index(j) >= F.col("time")), F.lit(0)), F.size("ranges") - 1)
    reaches = (F.col("k") < F.size("ranges") - 1) & (F.col("nth") < F.least("known", F.col("n") - 1)) & (F.col("time") + F.col("duration") >= F.coalesce("beyond", "last"))
    f = F.get("ranges", chosen).factor
    ended = half_even((F.col("time") + F.col("duration")) / f) * f - F.col("time")
    rows = rows.withColumn("duration", F.when(reaches, ended).otherwise(F.col("duration")))
    return rows.drop("ranges", "k", "factor", "n", "known", "beyond", "last", "nth", "counts")


def preprocess(tables: ScoreTables, c: TokenizerConfig, note_on_off: bool = False, tpq: int | None = None, snap: bool = True) -> ScoreTables:
    """Scores resampled and snapped onto the grids of ``c``.

    ``tpq`` overrides the resolution that follows from the grids; ``snap`` tells whether durations
    are snapped.  Idempotent: preprocessed scores stay as they are.
    """
    p = c.max_positions_per_beat
    tasks = task_count(tables.notes)
    scores, sections, signatures = tables.scores, None, None
    if c.use_time_signatures and tables.time_signatures is not None:
        signatures = with_default_signature(supported_signatures(tables.time_signatures, c), scores)
        finest = signatures.groupBy("score_id").agg(F.max("den").alias("den"))
        scores = scores.join(finest, "score_id").select("score_id", F.col("tpq").alias("old"), quotient(F.lit(p) * F.col("den"), 4).cast("int").alias("tpq"))
        signatures = signatures.join(scores, "score_id").withColumn("time", quotient(F.col("time") * F.col("tpq"), F.col("old"))).drop("old")
        signatures = align_signatures(signatures)
        sections = sections_of(signatures)
    else:
        scores = scores.select("score_id", F.col("tpq").alias("old"), F.lit(tpq or p).alias("tpq"))

    def scaled(df: DataFrame, *ticks: str) -> DataFrame:
        out = df.join(scores, "score_id")
        new = {t: resampled(F.col(t), F.col("tpq"), F.col("old")) for t in ticks}
        if "duration" in new:
            new["duration"] = F.greatest(new["duration"], F.lit(1))
        return out.withColumns(new).drop("old", "tpq")

    # Equal exchanges of all tables by score: what follows joins them, and appends them to each other, within scores.
    by_score = lambda df: df.repartition(tasks, "score_id")
    if sections is not None:
        sections, signatures = by_score(sections), by_score(signatures.drop("tpq"))
    result = ScoreTables(scores.drop("old"), tables.notes, sections=sections, time_signatures=signatures)

    def on_section_grid(df: DataFrame, *ticks: str) -> DataFrame:
        """Times on the positions of their section, which are further apart than the score's ticks."""
        if sections is None:
            return df
        df = df.withColumn("_factor", F.greatest(quotient(section_at(F.col("time")).tpb, p), F.lit(1)))
        return df.withColumns({t: half_even(F.col(t) / F.col("_factor")) * F.col("_factor") for t in ticks}).drop("_factor")

    def tracks(df: DataFrame) -> DataFrame:
        if c.use_programs:
            df = df.where(F.col("program").isin(list(c.programs))) if len(c.programs) < 129 else df
            return merge_tracks(df) if c.one_token_stream_for_programs else df
        return df

    # The one exchange of the notes: all joins and windows that follow are within scores.
    notes = tracks(by_score(tables.notes.where(in_pitch_range(c))))
    over_changes = note_on_off and sections is not None
    notes = scaled(notes, "time", "duration")
    if over_changes:  # ranges are found once a score
        notes = notes.join(sections.withColumn("ranges", _merged_factors(p)), "score_id")
    else:
        notes = with_sections(notes, result, c)
    if c.use_velocities:
        notes = notes.withColumn("velocity", snapped_velocity(c))
    notes = on_section_grid(notes.withColumn("onset", F.col("time")), "time")
    if snap and not note_on_off:
        notes = snap_durations(notes, c)
    elif over_changes:
        lasting = F.col("program").isin(list(c.use_note_duration_programs)) if len(c.use_note_duration_programs) < 129 else F.lit(True)
        moved = resnap_over_changes(notes.where(lasting))
        notes = moved if len(c.use_note_duration_programs) == 129 else moved.unionByName(notes.where(~lasting).drop("ranges"))
    notes = notes.drop("onset")
    notes = notes.drop("sections")
    if c.remove_duplicated_notes:
        notes = deduplicate_notes(notes)
    more: dict = {"notes": notes}
    if c.use_tempos and tables.tempos is not None:
        tempos = with_sections(scaled(tables.tempos, "time"), result, c)
        more["tempos"] = by_score(snap_tempos(on_section_grid(tempos, "time").drop("sections"), scores, c))
    if c.use_sustain_pedals and tables.pedals is not None:
        pedals = on_section_grid(with_sections(scaled(tracks(by_score(tables.pedals)), "time", "duration"), result, c), "time")
        pedals = merge_pedals(pedals.drop("sections"))
        more["pedals"] = snap_durations(with_sections(pedals, result, c), c).drop("sections") if c.sustain_pedal_duration else pedals
    if c.use_pitch_bends and tables.pitch_bends is not None:
        bends = on_section_grid(with_sections(scaled(tracks(by_score(tables.pitch_bends)), "time"), result, c), "time").drop("sections")
        more["pitch_bends"] = snap_bends(bends, c)
    return replace(result, **more)


def bars(tables: ScoreTables, c: TokenizerConfig, unit: str = "bar") -> DataFrame:
    """(score_id, n, tick): the ticks at which bars (or beats) start, before the last onset or change."""
    others = [t for t in (tables.tempos, tables.time_signatures, tables.pitch_bends) if t is not None]
    onsets = tables.notes.select("score_id", "time")
    for t in others:
        onsets = onsets.unionByName(t.select("score_id", "time"))
    last = onsets.groupBy("score_id").agg(F.greatest(F.max("time"), F.lit(1)).alias("last"))
    step = "tpbar" if unit == "bar" else "tpb"
    s = with_sections(last, tables, c).select("score_id", "last", F.explode("sections").alias("s"))
    stop = F.least(F.coalesce(F.col("s.end"), F.col("last")), F.col("last")) - 1
    ticks = F.when(stop >= F.col("s.start"), F.sequence(F.col("s.start"), stop, F.col(f"s.{step}")))
    rows = s.select("score_id", F.explode(ticks).alias("tick"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("score_id").orderBy("tick")).cast("long") - 1).select("score_id", "n", "tick")


def clip_to_bars(tables: ScoreTables, c: TokenizerConfig, limit: int) -> ScoreTables:
    """Notes that start in the first ``limit`` bars."""
    notes = with_sections(tables.notes, tables, c)
    return replace(tables, notes=notes.where(bar_at(F.col("time"), section_at(F.col("time"))) < limit).drop("sections"))
