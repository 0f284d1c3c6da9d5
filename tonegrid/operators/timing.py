"""Time tokens of the one-dimensional tokenizers, from closed forms over one window per stream.

After every event the clock of these encoders stands at the event's own tick, so what comes before
an event follows from the event before it (lag), the latest note end so far (running maximum) and
the section of the time signature it falls in: no state is carried from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions import by_value, clamp, literal_array, lookup, quotient, token
from ..grids import Grids
from .events import NO_TOKENS, ORDER, stream_order
from .scores import ScoreTables, bar_at, bar_tick, section_at, with_sections

SOUNDING = ("Pitch", "PitchDrum", "NoteOn", "DrumOn", "PitchIntervalTime", "PitchIntervalChord")
MARKING = ("Program", "Tempo", "TimeSig", "Pedal", "PedalOff", "PitchBend", "Chord")
#: What of a section goes along with a row.
SECTION = ("start", "num", "den", "tpb", "tpbar", "first_bar")


def greedy(kind: str, gap: Column, tpb: Column, g: Grids, rest: bool = False) -> Column:
    """The tokens that fill a gap, the largest span first."""

    def filled(t: int) -> Column:
        table = g.tick_table(t, rest)
        longest = f"{kind}_{table.name_of[table.longest]}"
        tail = F.get(literal_array([[f"{kind}_{n}" for n in names] for names in table.greedy], "array<string>"), (gap % table.longest).cast("int"))
        return F.concat(F.array_repeat(F.lit(longest), quotient(gap, table.longest).cast("int")), tail)

    return F.coalesce(F.when(gap > 0, by_value(tpb, g.possible_ticks_per_beat, filled)), F.expr(NO_TOKENS))


def unfilled(gap: Column, tpb: Column, g: Grids) -> Column:
    """Ticks that the greedy rests leave of a gap."""

    def left(t: int) -> Column:
        table = g.tick_table(t, rest=True)
        return lookup(table.greedy_left, gap % table.longest)

    return by_value(tpb, g.possible_ticks_per_beat, left)


def shortest_rest(tpb: Column, g: Grids) -> Column:
    return by_value(tpb, g.possible_ticks_per_beat, lambda t: F.lit(g.tick_table(t, rest=True).shortest))


def nearest_shift(gap: Column, g: Grids) -> Column:
    """One ``TimeShift`` for a gap: the nearest span; ``0.0.1`` for none."""
    table = g.tick_table(g.positions_per_beat)
    names = ["0.0.1", *(table.name_of[table.nearest_ticks[i]] for i in range(1, table.longest + 1))]
    return token("TimeShift", lookup(names, clamp(gap, 0, table.longest), "string"))


def timed(events: DataFrame, tables: ScoreTables, c: TokenizerConfig, marking: tuple[str, ...] = MARKING, parts: tuple[str, ...] = SECTION) -> DataFrame:
    """Events, or runs of them, with ``previous`` (tick before, null for the first), ``sounded`` (latest note end or mark before) and ``section``.

    A time signature belongs to the section that it ends.  Runs hold the sections that signatures open, so each row
    has that of the last one before it, ``parts`` of it; to events the sections of their score are joined.
    """
    w = stream_order()
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = F.when(F.col("type").isin(list(marking)), F.col("time"))
    if "tokens" in events.columns:
        reach = F.greatest("note_end", marked)
    else:
        reach = F.when(F.col("type").isin(list(SOUNDING)), F.col("note_end")).otherwise(marked)
    rows, more = events.withColumn("reach", reach), {}
    carried = "section" in events.columns
    if carried:
        more = {f"section_{n}": F.coalesce(F.last_value(f"section.{n}", ignoreNulls=True).over(earlier), F.col(f"section.{n}")) for n in parts}
    else:
        at = F.when(F.col("type") == "TimeSig", F.col("time") - 1).otherwise(F.col("time"))
        # Of all sections only its own goes with a row through the sort.
        rows = with_sections(rows, tables, c).withColumn("section", section_at(at)).drop("sections")
    rows = rows.withColumns(
        {
            "previous": F.lag("time").over(w),
            "previous_type": F.lag("type").over(w),
            "sounded": F.coalesce(F.max("reach").over(earlier), F.lit(0)),
            **more,
        }
    ).drop("reach")
    if carried:
        rows = rows.withColumn("section", F.struct(*(F.col(f"section_{n}").alias(n) for n in parts))).drop(*more)
    return rows


def laid_out(rows: DataFrame, before: Column, own: Column | None = None) -> DataFrame:
    """(score_id, seq_idx, pos, token, tick): each event's token, or run's tokens, after the tokens ``before`` it."""
    if own is None:
        own = F.col("tokens") if "tokens" in rows.columns else F.array(token(F.col("type"), F.col("value")))
    tokens = F.concat(before, own)
    rows = rows.withColumn("tokens", tokens).withColumn("n", F.size("tokens").cast("long"))
    rows = rows.withColumn("first", F.sum("n").over(stream_order().rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))  # before the rows are exploded
    rows = rows.select("score_id", "seq_idx", F.col("time").alias("tick"), "first", F.posexplode("tokens").alias("i", "token"))
    return rows.select("score_id", "seq_idx", (F.col("first") + F.col("i")).alias("pos"), "token", "tick")


def rest_and_shift(events: DataFrame, tables: ScoreTables, c: TokenizerConfig, marking: tuple[str, ...] = MARKING) -> DataFrame:
    """Rests, then time shifts, before every event at a new tick."""
    g = Grids(c)
    rows = timed(events, tables, c, marking, ("tpb",))
    tpb, time, clock = F.col("section.tpb"), F.col("time"), F.coalesce("previous", F.lit(0))
    moved = time != clock
    if not c.use_rests:
        return laid_out(rows, F.when(moved, greedy("TimeShift", time - clock, tpb, g)).otherwise(F.expr(NO_TOKENS)))
    gap = time - F.col("sounded")
    rested = moved & (gap >= shortest_rest(tpb, g))
    # Columns of their own: written out in every use, they make a method too long for the JVM to compile.
    rows = rows.withColumns({"rested": rested, "gap": gap})
    rows = rows.withColumn("shift", F.when(F.col("rested"), unfilled(F.col("gap"), tpb, g)).otherwise(time - clock))
    before = F.concat(F.when(F.col("rested"), greedy("Rest", F.col("gap"), tpb, g, rest=True)).otherwise(F.expr(NO_TOKENS)), greedy("TimeShift", F.col("shift"), tpb, g))
    return laid_out(rows, F.when(moved, before).otherwise(F.expr(NO_TOKENS)))


def tsd(events: DataFrame, tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    return rest_and_shift(events, tables, c)


def midilike(events: DataFrame, tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    return rest_and_shift(events, tables, c, tuple(m for m in MARKING if m != "TimeSig"))


def structured(events: DataFrame, tables: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """One time shift before the first event of every note, a zero one included."""
    opens = F.col("type").isin(["Program"] if c.one_token_stream_for_programs else ["Pitch", "PitchDrum"])
    w = stream_order()
    rows = events.withColumn("opened", F.when(opens, F.col("time")))
    clock = F.coalesce(F.last_value("opened", ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("gap", F.col("time") - clock)
    return laid_out(rows, F.when(opens, F.array(nearest_shift(F.col("gap"), Grids(c)))).otherwise(F.expr(NO_TOKENS)))


def remi(events: DataFrame, tables: ScoreTables, c: TokenizerConfig, controlled: bool = False) -> DataFrame:
    """Rests, new bars (with their signature) and a position before every event at a new tick.

    Bars that a rest runs into are not written; a time signature stands for the position of its
    tick, and the next event has one of its own.  In ``controlled`` streams controls of the track
    come before the first bar, and those of a bar between its start and the first position.
    """
    g, params = Grids(c), c.additional_params
    rows = timed(events, tables, c)
    time, section, tpb = F.col("time"), F.col("section"), F.col("section.tpb")
    signature = F.col("type") == "TimeSig"
    # A bar line after the last section's start: bars of the old section up to the signature's own.
    bar = F.when(signature & (time > 0), bar_at(time, section)).otherwise(bar_at(time, section))
    moved = F.col("previous").isNull() | (time != F.col("previous")) | (F.col("previous_type") == "TimeSig")
    done = F.coalesce(F.lag("bar").over(stream_order()), F.lit(-1))
    placed = F.lit(False)  # a position without a move
    if controlled:
        of_track, of_bar = F.col("type").startswith("ACTrack"), F.col("type").startswith("ACBar")
        first = F.coalesce(F.col("previous_type").startswith("ACTrack"), F.lit(True))
        moved, bar = ~of_track & (moved | first), F.when(~of_track, bar)
        placed = ~of_bar & ~of_track & F.coalesce(F.col("previous_type").startswith("ACBar"), F.lit(False))
    rows = rows.withColumns({"moved": moved, "placed": placed, "bar": bar})
    rests = F.expr(NO_TOKENS)
    if c.use_rests:
        gap = time - F.col("sounded")
        rows = rows.withColumn("rested", F.col("moved") & (gap >= shortest_rest(tpb, g)))
        rests = F.when(F.col("rested"), greedy("Rest", gap, tpb, g, rest=True)).otherwise(rests)
        reached = bar_at(time - unfilled(gap, tpb, g), section)
        done = F.when(F.col("rested"), F.greatest(done, reached)).otherwise(done)
    rows = rows.withColumn("done", done)
    named = F.concat(F.lit("TimeSig_"), F.col("section.num").cast("string"), F.lit("/"), F.col("section.den").cast("string"))

    def bar_tokens(n: Column) -> Column:
        parts = []
        if params.get("use_bar_end_tokens"):
            parts.append(F.when(n > 0, F.lit("Bar_End")))
        parts.append(token("Bar", n) if params.get("max_bar_embedding") else F.lit("Bar_None"))
        if c.use_time_signatures:
            parts.append(F.when(~(signature & (n == F.col("bar"))), named))
        return F.filter(F.array(*parts), lambda x: x.isNotNull())

    new = F.when(F.col("bar") > F.col("done"), F.flatten(F.transform(F.sequence(F.col("done") + 1, F.col("bar")), bar_tokens)))
    place = quotient(time - bar_tick(F.col("bar"), section), F.greatest(quotient(tpb, g.positions_per_beat), F.lit(1)))
    position = F.when(~signature & ~F.col("type").startswith("ACBar"), F.array(token("Position", place)))
    nothing = F.expr(NO_TOKENS)
    alone = F.when(F.col("placed"), F.coalesce(position, nothing)).otherwise(nothing)
    before = F.when(F.col("moved"), F.concat(rests, F.coalesce(new, nothing), F.coalesce(position, nothing))).otherwise(alone if controlled else nothing)
    out = laid_out(rows, before)
    return _with_trailing_bars(out, rows, c) if params.get("add_trailing_bars") else out


def _with_trailing_bars(tokens: DataFrame, rows: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Bars after the last event up to the end of the last note."""
    last = rows.groupBy("score_id", "seq_idx").agg(
        F.max(F.coalesce("note_end", "time")).alias("end"), F.max("bar").alias("bar"), F.max_by("section", F.struct(*ORDER)).alias("section")
    )
    count = tokens.groupBy("score_id", "seq_idx").agg(F.count("*").alias("n"))
    more = last.withColumn("until", bar_at(F.col("end"), F.col("section"))).where("until > bar").join(count, ["score_id", "seq_idx"])
    named = F.concat(F.lit("TimeSig_"), F.col("section.num").cast("string"), F.lit("/"), F.col("section.den").cast("string"))
    one = lambda n: F.filter(
        F.array(
            F.lit("Bar_End") if c.additional_params.get("use_bar_end_tokens") else F.lit(None),
            token("Bar", n) if c.additional_params.get("max_bar_embedding") else F.lit("Bar_None"),
            named if c.use_time_signatures else F.lit(None),
        ),
        lambda x: x.isNotNull(),
    )
    tail = more.select("score_id", "seq_idx", "end", "n", F.posexplode(F.flatten(F.transform(F.sequence(F.col("bar") + 1, F.col("until")), one))).alias("i", "token"))
    return tokens.unionByName(tail.select("score_id", "seq_idx", (F.col("n") + F.col("i")).alias("pos"), "token", F.col("end").alias("tick")))


def with_track_header(tokens: DataFrame, programs: DataFrame, markers: bool) -> DataFrame:
    """Multi-stream tokens with the track's ``Program`` first, on request between track markers.

    ``programs`` has (score_id, seq_idx, program).
    """
    head = 2 if markers else 1
    moved = tokens.withColumn("pos", F.col("pos") + head)
    size = tokens.groupBy("score_id", "seq_idx").agg(F.count("*").alias("n")).join(programs, ["score_id", "seq_idx"])
    program = F.struct(F.lit(head - 1).cast("long").alias("pos"), token("Program", F.col("program")).alias("token"))
    extra = [program]
    if markers:
        extra += [F.struct(F.lit(0).cast("long").alias("pos"), F.lit("Track_Start").alias("token")), F.struct((F.col("n") + head).alias("pos"), F.lit("Track_End").alias("token"))]
    more = size.select("score_id", "seq_idx", F.explode(F.array(*extra)).alias("x")).select("score_id", "seq_idx", "x.pos", "x.token", F.lit(0).cast("long").alias("tick"))
    return moved.unionByName(more)


def concatenated(tokens: DataFrame) -> DataFrame:
    """The streams of a score one after the other, as stream 0."""
    size = tokens.groupBy("score_id", "seq_idx").agg(F.count("*").alias("n"))
    w = Window.partitionBy("score_id").orderBy("seq_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = size.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    out = tokens.join(start, ["score_id", "seq_idx"])
    return out.select("score_id", F.lit(0).alias("seq_idx"), (F.col("first") + F.col("pos")).alias("pos"), "token", "tick")
