"""Token-syntax errors: successions of types, repeated notes, positions that don't rise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions import literal_array, token_type, token_value
from ..graph import Graph, edges
from .decode import SEQ, before, by_place, octuple_places, parsed, with_pitch

NOTES = ("Pitch", "PitchDrum", "NoteOn", "DrumOn", "PitchIntervalTime", "PitchIntervalChord")
OFFS = ("NoteOff", "DrumOff")
CLOCK = ("TimeShift", "Rest", "Position")


def _succession(rows: DataFrame, graph: Graph) -> DataFrame:
    """``bad_type``: whether a token's type may not follow the one before (first tokens never)."""
    rows = rows.withColumn("from_type", F.lag("type").over(by_place()))
    table = edges(rows.sparkSession, graph).select("from_type", F.col("to_type").alias("type"), F.lit(True).alias("legal"))
    out = rows.join(F.broadcast(table), ["from_type", "type"], "left")
    return out.withColumn("bad_type", F.col("from_type").isNotNull() & F.col("legal").isNull()).drop("legal")


def _repeated(rows: DataFrame, reset: Column, pitch: Column, keys: list[str]) -> DataFrame:
    """``repeated``: whether a pitch occurred before since the last reset, within ``keys``."""
    rows = rows.withColumn("resets", F.sum(F.when(reset, 1).otherwise(0)).over(before())).withColumn("heard", pitch)
    w = Window.partitionBy(*SEQ, "resets", *keys, "heard").orderBy("pos")
    return rows.withColumn("repeated", F.col("heard").isNotNull() & (F.row_number().over(w) > 1))


def _coded(tokens: DataFrame, graph: Graph, c: TokenizerConfig) -> tuple[DataFrame, Callable[..., Column]]:
    """Tokens with ``bad_type``, ``program``, ``sound`` and the codes of their types, and a test of ``code`` for types.

    Types are numbers and values are read once, so what the windows sort and copy has no texts.  ``code`` is null for
    a null token and 0 for a type that the graph doesn't know.
    """
    types = sorted({t for a, targets in graph.items() for t in (a, *targets)} | {*NOTES, *OFFS, *CLOCK, "Program", "Bar", "TimeSig"})
    place = {t: i + 1 for i, t in enumerate(types)}
    legal = [False] * (len(types) + 1) ** 2
    for a, targets in graph.items():
        for b in targets:
            legal[place[a] * (len(types) + 1) + place[b]] = True
    is_in = lambda *names: F.col("code").isin([place[n] for n in names])
    code = F.array_position(F.array(*map(F.lit, types)), F.col("type")).cast("int")
    rows = parsed(tokens).withColumn("code", F.when(F.col("type").isNotNull(), code))
    # What is wrong with a value counts only where the value does (see `_known`).
    number = F.when(is_in(*NOTES, "Program"), F.col("value").cast("int")).when(is_in(*OFFS, "Position"), F.expr("try_cast(value as int)")).when(F.col("token") == "Bar_None", 1)
    rows = rows.withColumn("number", number)
    own = F.when(is_in("Program"), F.col("number"))
    every = Window.partitionBy(*SEQ).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    program = F.last_value(own, ignoreNulls=True).over(before()) if c.one_token_stream_for_programs else F.first_value(own, ignoreNulls=True).over(every)
    w = by_place()
    rows = rows.withColumns({"from_code": F.lag("code").over(w), "two": F.lag("code", 2).over(w), "program": F.coalesce(program, F.lit(0))})
    allowed = F.get(literal_array(legal, "boolean"), F.col("from_code") * (len(types) + 1) + F.col("code"))
    rows = rows.withColumn("bad_type", F.col("from_code").isNotNull() & ~F.coalesce(allowed, F.lit(False)))
    if c.use_pitch_intervals:
        rows = with_pitch(rows, c)
    else:
        rows = rows.withColumn("sound", F.when(is_in(*NOTES), F.col("number")))
    kept = ["code", "from_code", "two", "number", "program", "sound", "bad_type"]
    return rows.select(*SEQ, "pos", *kept), lambda *names, of="code": F.col(of).isin([place[n] for n in names])


def _known(number: str) -> Column:
    """A number that was read with care; where it was none, what a cast of it gives or raises."""
    return F.coalesce(number, F.lit("not a number").cast("int"))


def _placed(tokens: DataFrame, graph: Graph, c: TokenizerConfig) -> DataFrame:
    """Tokens with ``bad_type`` and ``bad_time``; notes with ``resets`` and ``heard``: two of one pitch of a program are repeated."""
    rows, is_in = _coded(tokens, graph, c)
    good = ~F.col("bad_type")
    bar = good & is_in("Bar") & F.col("number").isNotNull()
    clears = bar | (good & is_in(*CLOCK))
    place = F.when(good & is_in("Position"), _known("number"))
    earlier = by_place().rowsBetween(Window.unboundedPreceding, -1)
    # The last position of the bar: a bar sets it back.
    last = F.last_value(F.when(bar, -1).otherwise(place), ignoreNulls=True).over(earlier)
    rows = rows.withColumns({"resets": F.sum(F.when(clears, 1).otherwise(0)).over(before()), "last": F.coalesce(last, F.lit(-1)), "place": place})
    rested = is_in("Rest", of="from_code") | (is_in("TimeSig", of="from_code") & F.coalesce(is_in("Rest", of="two"), F.lit(False)))
    late = F.col("place").isNotNull() & (F.col("place") <= F.col("last")) & ~F.coalesce(rested, F.lit(False)) & F.col("from_code").isNotNull()
    heard = F.when(good & is_in(*NOTES), F.col("sound"))
    return rows.select(*SEQ, "pos", "bad_type", late.alias("bad_time"), "resets", "program", heard.alias("heard"))


def token_errors(tokens: DataFrame, graph: Graph, c: TokenizerConfig) -> DataFrame:
    """(score_id, seq_idx, pos, bad_type, bad_note, bad_time) of one-dimensional tokens.

    What follows a bad type is not counted as an error of note or time.  Repeated notes count only
    where duplicates are removed; a position may stand still after a rest.
    """
    rows = _placed(tokens, graph, c)
    note = F.lit(False)
    if c.remove_duplicated_notes:
        same = Window.partitionBy(*SEQ, "resets", "program", "heard").orderBy("pos")
        note = F.col("heard").isNotNull() & (F.row_number().over(same) > 1)
    return rows.select(*SEQ, "pos", "bad_type", note.alias("bad_note"), "bad_time")


def token_error_counts(tokens: DataFrame, graph: Graph, c: TokenizerConfig) -> DataFrame:
    """:func:`error_counts` of :func:`token_errors`.  Which of equal notes is the first doesn't matter, so they are not sorted."""
    rows, count = _placed(tokens, graph, c), lambda n: F.sum(F.col(n).cast("long"))
    key = lambda n: F.when(F.col("heard").isNotNull(), F.col(n)).alias(n)
    rows = rows.select(*SEQ, "bad_type", "bad_time", key("resets"), key("program"), "heard")
    groups = rows.groupBy(*SEQ, "resets", "program", "heard").agg(F.count("*").alias("n"), (count("bad_type") + count("bad_time")).alias("wrong"))
    repeated = F.when(F.col("heard").isNotNull(), F.col("n") - 1).otherwise(0) if c.remove_duplicated_notes else F.lit(0)
    return groups.groupBy(*SEQ).agg(F.sum("n").alias("n_tokens"), F.sum(F.col("wrong") + repeated).alias("n_errors"))


def _balanced(tokens: DataFrame, graph: Graph, c: TokenizerConfig) -> DataFrame:
    """Tokens with ``bad_type``; ons and offs with ``heard``, their pitch, and ``step``, 1 or -1."""
    rows, is_in = _coded(tokens, graph, c)
    on, off = is_in(*NOTES), is_in(*OFFS)
    heard = F.when(on, F.col("sound")).when(off, _known("number"))
    return rows.select(*SEQ, "pos", "bad_type", "program", heard.alias("heard"), F.when(on, 1).when(off, -1).otherwise(0).alias("step"))


def note_off_errors(tokens: DataFrame, graph: Graph, c: TokenizerConfig) -> DataFrame:
    """As :func:`token_errors` for note-on/off tokens: ``bad_note`` marks offs without an open note."""
    rows = _balanced(tokens, graph, c)
    w = Window.partitionBy(*SEQ, "program", "heard").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("balance", F.sum("step").over(so_far))
    rows = rows.withColumn("lowest", F.least(F.min("balance").over(so_far), F.lit(0)))
    unmatched = (F.col("step") == -1) & (F.col("lowest") < F.coalesce(F.lag("lowest").over(w), F.lit(0)))
    return rows.select(*SEQ, "pos", "bad_type", unmatched.alias("bad_note"), F.lit(False).alias("bad_time"))


def note_off_error_counts(tokens: DataFrame, graph: Graph, c: TokenizerConfig) -> DataFrame:
    """:func:`error_counts` of :func:`note_off_errors`: offs without an open note are as many as the balance falls below zero.

    Only ons and offs are sorted by pitch; a stream's last token tells how many tokens and bad types it has.
    """
    w = by_place()
    rows = _balanced(tokens, graph, c).withColumns({"n": F.row_number().over(w), "wrong": F.sum(F.col("bad_type").cast("long")).over(before()), "ahead": F.lead("pos").over(w)})
    rows = rows.where("heard is not null or ahead is null").select(*SEQ, "pos", "program", "heard", "step", "n", "wrong")
    pitch = Window.partitionBy(*SEQ, "program", "heard").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("balance", F.sum("step").over(pitch))
    lines = rows.groupBy(*SEQ, "program", "heard").agg((-F.least(F.min("balance"), F.lit(0))).alias("unmatched"), F.max("n").alias("n"), F.max("wrong").alias("wrong"))
    return lines.groupBy(*SEQ).agg(F.max("n").cast("long").alias("n_tokens"), (F.sum("unmatched") + F.max("wrong")).alias("n_errors"))


def octuple_errors(rows: DataFrame, c: TokenizerConfig) -> DataFrame:
    """Rows with a missing place, a bar or position that falls, or a repeated pitch."""
    names = octuple_places(c)
    value = lambda n: token_value(F.get(F.col("tokens"), F.lit(names[n])))
    missing = F.exists("tokens", lambda t: token_value(t) == "None")
    out = rows.select(*SEQ, "pos", missing.alias("missing"), *(F.when(~missing, value(n).cast("long")).alias(n) for n in ("pitch", "position", "bar")), (value("program") if c.use_programs else F.lit("0")).alias("program"))
    earlier = by_place().rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("reached", F.coalesce(F.max("bar").over(earlier), F.lit(-1)))
    out = out.withColumn("bar_now", F.greatest("reached", F.coalesce("bar", F.lit(-1))))
    in_bar = Window.partitionBy(*SEQ, "bar_now").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("placed", F.coalesce(F.max("position").over(in_bar), F.lit(-1)))
    out = out.withColumn("place_now", F.greatest("placed", F.coalesce("position", F.lit(-1))))
    late = (F.col("bar") < F.col("reached")) | (F.col("position") < F.col("placed"))
    same = Window.partitionBy(*SEQ, "bar_now", "place_now", "program", "pitch").orderBy("pos")
    note = F.col("pitch").isNotNull() & (F.row_number().over(same) > 1) if c.remove_duplicated_notes else F.lit(False)
    late = F.coalesce(late, F.lit(False))
    # A row counts once, whatever is wrong with it.
    return out.select(*SEQ, "pos", F.col("missing").alias("bad_type"), (note & ~late).alias("bad_note"), late.alias("bad_time"))


def cpword_kind(c: TokenizerConfig) -> Column:
    """The token that tells what a compound row is: the pitch, the bar or position, or the first other one from the end."""
    at = lambda i: F.get(F.col("tokens"), F.lit(i))
    other = F.get(F.filter(F.reverse(F.slice("tokens", 4, 8)), lambda t: token_type(t) != "Ignore"), F.lit(0))
    return F.when(at(0) == "Family_Note", at(2)).when(at(1) != "Ignore_None", at(1)).otherwise(F.coalesce(other, F.lit("PAD_None")))


def cpword_errors(rows: DataFrame, graph: Graph, c: TokenizerConfig) -> DataFrame:
    place = 3 + c.use_velocities + c.uses_durations
    program = token_value(F.get(F.col("tokens"), F.lit(place))) if c.use_programs else F.lit("0")
    long = rows.select(*SEQ, "pos", cpword_kind(c).alias("token"), program.alias("own"))
    out = long.select(*SEQ, "pos", "token", token_type(F.col("token")).alias("type"), token_value(F.col("token")).alias("value"), "own")
    out = _succession(out, graph)
    good = ~F.col("bad_type")
    clears = good & F.col("type").isin("Bar", "Position")
    out = _repeated(out, clears, F.when(good & F.col("type").isin("Pitch", "PitchDrum"), F.col("value")), ["own"])
    out = out.withColumn("bars", F.sum(F.when(good & (F.col("type") == "Bar"), 1).otherwise(0)).over(before()))
    in_bar = Window.partitionBy(*SEQ, "bars").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    place_now = F.when(good & (F.col("type") == "Position"), F.col("value").cast("int"))
    out = out.withColumns({"place": place_now, "last": F.coalesce(F.last_value(place_now, ignoreNulls=True).over(in_bar), F.lit(-1))})
    late = F.col("place").isNotNull() & (F.col("place") <= F.col("last")) & (F.coalesce(F.col("from_type"), F.lit("")) != "Rest") & F.col("from_type").isNotNull()
    note = F.col("repeated") if c.remove_duplicated_notes else F.lit(False)
    return out.select(*SEQ, "pos", "bad_type", note.alias("bad_note"), late.alias("bad_time"))


def mumidi_errors(rows: DataFrame, graph: Graph, c: TokenizerConfig) -> DataFrame:
    at = lambda i: F.get(F.col("tokens"), F.lit(i))
    number = lambda i: F.expr(f"try_cast(substring_index(tokens[{i}], '_', -1) as int)")
    padded = F.exists("tokens", lambda t: token_type(t).isin("PAD", "MASK"))
    out = rows.select(*SEQ, "pos", at(0).alias("token"), token_type(at(0)).alias("type"), token_value(at(0)).alias("value"), number(1).alias("bar"), F.coalesce(number(2), F.lit(-1)).alias("place"), padded.alias("padded"))
    out = _succession(out, graph)
    good = ~F.col("bad_type")
    clears = good & F.col("type").isin("Bar", "Position", "Program")
    out = _repeated(out, clears, F.when(good & (F.col("type") == "Pitch"), F.col("value")), [])
    out = out.withColumn("bars", F.sum(F.when(good & (F.col("type") == "Bar"), 1).otherwise(0)).over(before()))
    in_bar = Window.partitionBy(*SEQ, "bars").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(good & (F.col("type") == "Position"), F.col("value").cast("int"))
    out = out.withColumns({"own": own, "last": F.coalesce(F.max(own).over(in_bar), F.lit(-1))})
    late = F.col("own").isNotNull() & ((F.col("own") <= F.col("last")) | (F.col("own") != F.col("place")))
    behind = good & F.col("from_type").isNotNull() & (F.col("place") < F.col("last")) & ~F.col("type").isin("Bar")
    note = F.col("repeated") if c.remove_duplicated_notes else F.lit(False)
    return out.select(*SEQ, "pos", (F.col("bad_type") | F.col("padded")).alias("bad_type"), note.alias("bad_note"), (late | behind).alias("bad_time"))


def error_counts(errors: DataFrame) -> DataFrame:
    """(score_id, seq_idx, n_tokens, n_errors) from rows of any check."""
    wrong = lambda n: F.sum(F.col(n).cast("long"))
    return errors.groupBy(*SEQ).agg(F.count("*").alias("n_tokens"), (wrong("bad_type") + wrong("bad_note") + wrong("bad_time")).alias("n_errors"))


def error_ratio(errors: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """:func:`error_counts` with ``ratio``: errors by tokens, or by ``sizes`` (score_id, seq_idx, size) before ids of a trained model were decoded."""
    return with_ratio(error_counts(errors), sizes)


def with_ratio(counts: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``counts`` with ``ratio``, as :func:`error_ratio` has it."""
    if sizes is None:
        return counts.withColumn("ratio", F.col("n_errors") / F.col("n_tokens"))
    return counts.join(sizes, SEQ).withColumn("ratio", F.col("n_errors") / F.col("size")).drop("size")
