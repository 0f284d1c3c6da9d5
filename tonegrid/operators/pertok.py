"""PerTok: expressive timing on a grid of its own.

A bar begins half a smallest step before its line, so the bar of an event follows from its tick and
the time signatures before it.  Within a bar a clock stands at the last written position (or the
sum of the written shifts), which the rounding of one step moves for the next; it starts anew in
every bar, so bars are folded apart from each other, each from the ticks of its own events.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions import clamp, lookup, quotient, token
from ..grids import Span, span_name
from .events import ORDER, stream_order

TIMED = ("Pitch", "PitchDrum", "PitchIntervalTime", "PitchIntervalChord", "NoteOn", "DrumOn")
SECTION = "struct<tick:bigint,length:bigint,bar:bigint>"


def nearest_table(values: list[int], low: int, high: int) -> np.ndarray:
    """For every whole number of a range the index of the nearest value, of several as near the first."""
    return np.abs(np.array(values)[None, :] - np.arange(low, high + 1)[:, None]).argmin(1)


@dataclass(frozen=True)
class PerTokGrid:
    tpq: int
    durations: list[Span]
    ticks: list[int]
    positions: list[int]
    least_shift: int
    use_positions: bool
    use_microtiming: bool
    micro_ticks: list[int]

    @classmethod
    def of(cls, c: TokenizerConfig) -> PerTokGrid:
        p = c.additional_params
        tpq = int(p["ticks_per_quarter"])
        spans = [(beat, tpq // res * pos, tpq) for (lo, hi), res in sorted(c.beat_res.items()) for beat in range(lo, hi) for pos in range(res) if beat or pos]
        ticks = [beat * tpq + sub for beat, sub, _ in spans]
        micro: list[int] = []
        if p.get("use_microtiming"):
            reach, n = int(p["max_microtiming_shift"] * tpq), int(p["num_microtiming_bins"])
            micro = [int(np.floor(abs(v) + 0.5) * np.sign(v)) for v in np.linspace(-reach, reach, n + 1)]
        return cls(tpq, spans, ticks, sorted({0, *ticks}), int(min(ticks) * 0.5), bool(p.get("use_position_toks")), bool(p.get("use_microtiming")), micro)

    def nearest(self, values: list[int], names: list[str], x: Column, low: int = 0) -> Column:
        """The name of the value nearest to ``x``."""
        high = max(values)
        table = [names[i] for i in nearest_table(values, low, high)]
        return lookup(table, clamp(x, low, high) - low, "string")

    def bars_before(self, tick: Column, section: Column) -> Column:
        """Bars of a section that have begun and ended by a tick."""
        return F.greatest(F.ceil((tick - section.tick + self.least_shift) / section.length) - 1, F.lit(0)).cast("long")

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """The nearest step of a tick (from a little before the bar line) or of a gap, and the ticks of each step."""
        values, low = (self.positions, -self.least_shift) if self.use_positions else (self.ticks, 0)
        return nearest_table(values, low, max(values)), np.array(values)

    def clocked(self, ticks: np.ndarray) -> np.ndarray:
        """Of the notes of a bar (ticks from its line, in order): the step written before each, or -1; then what is left of each tick."""
        (table, values), step, clock = self.steps, [], 0
        if self.use_positions:
            number = table[np.clip(ticks + self.least_shift, 0, len(table) - 1)]
            for tick, n, at in zip(ticks.tolist(), number.tolist(), values[number].tolist(), strict=True):
                moved = tick - clock >= self.least_shift
                step.append(n if moved else -1)
                clock = at if moved else clock
            return np.append(np.array(step, np.int64), ticks - values[number])
        left = []
        for tick in ticks.tolist():
            n = -1
            if tick - clock >= self.least_shift:
                n = int(table[min(tick - clock, len(table) - 1)])
                clock += self.ticks[n]
            step.append(n)
            left.append(tick - clock)
        return np.array(step + left, np.int64)


def _sections(events: DataFrame, grid: PerTokGrid) -> DataFrame:
    """(score_id, seq_idx, sections): where the bar length of a stream changes; the n-th counts after n time signatures."""
    whole = F.expr(f"cast(array(named_struct('tick', 0L, 'length', {4 * grid.tpq}L, 'bar', 0L)) as array<{SECTION}>)")
    parts = F.split("value", "/")
    length = quotient(parts[0].cast("long") * 4 * grid.tpq, parts[1].cast("long"))
    changes = F.sort_array(F.collect_list(F.when(F.col("type") == "TimeSig", F.struct(*ORDER, length.alias("length")))))

    def then(sections: Column, change: Column) -> Column:
        last = F.element_at(sections, -1)
        n = grid.bars_before(change.time, last)
        one = F.struct((last.tick + n * last.length).alias("tick"), change.length.alias("length"), (last.bar + n).alias("bar"))
        return F.concat(sections, F.array(one.cast(SECTION)))

    return events.groupBy("score_id", "seq_idx").agg(F.aggregate(changes, whole, then).alias("sections"))


def pertok(events: DataFrame, c: TokenizerConfig) -> DataFrame:
    """(score_id, seq_idx, pos, token, tick) of event rows whose durations are given in ticks."""
    grid, keys = PerTokGrid.of(c), ["score_id", "seq_idx"]
    steps = [f"Position_{p}" for p in grid.positions] if grid.use_positions else [f"TimeShift_{span_name(s)}" for s in grid.durations]
    rows = events
    if c.use_time_signatures:
        earlier = stream_order().rowsBetween(Window.unboundedPreceding, -1)
        number = F.coalesce(F.sum(F.when(F.col("type") == "TimeSig", 1).otherwise(0)).over(earlier), F.lit(0))
        rows = rows.withColumn("number", number.cast("int")).join(_sections(events, grid), keys).withColumn("section", F.get("sections", F.col("number")))
    else:
        rows = rows.withColumn("section", F.expr(f"cast(named_struct('tick', 0L, 'length', {4 * grid.tpq}L, 'bar', 0L) as {SECTION})"))
    n = grid.bars_before(F.col("time"), F.col("section"))
    rows = rows.withColumns({"bar": F.col("section.bar") + n, "bar_tick": F.col("section.tick") + n * F.col("section.length")})
    spans = [span_name(s) for s in grid.durations]
    value = F.when(F.col("type") == "Duration", grid.nearest(grid.ticks, spans, F.expr("try_cast(value as bigint)"))).otherwise(F.col("value"))
    in_bar = Window.partitionBy(*keys, "bar").orderBy(*ORDER)
    timed = F.col("type").isin(list(TIMED))
    rows = rows.select(*keys, "bar", "bar_tick", F.col("section.length").alias("length"), *ORDER, token(F.col("type"), value).alias("token"), timed.alias("timed"))
    rows = rows.withColumn("nth", F.sum(F.col("timed").cast("int")).over(in_bar).cast("int") - 1)
    one = F.struct(*ORDER, "token", "timed", "nth", "bar_tick", "length")
    ticks = F.sort_array(F.collect_list(F.when(F.col("timed"), F.struct(*ORDER, (F.col("time") - F.col("bar_tick")).alias("tick")))))
    bars = rows.groupBy(*keys, "bar").agg(F.collect_list(one).alias("events"), F.transform(ticks, lambda t: t.tick).alias("ticks"))

    @F.pandas_udf("array<bigint>")
    def marks(ticks: pd.Series) -> pd.Series:
        """For the notes of each bar the numbers of the steps before them, then what is left of their ticks."""
        return pd.Series([grid.clocked(np.asarray(t, np.int64)) for t in ticks])

    # Everything of a bar is in its row, so the events come out of it with their marks.
    rows = bars.select(*keys, "bar", marks("ticks").alias("marks"), F.size("ticks").alias("notes"), F.explode("events").alias("e"))
    rows = rows.select(*keys, "bar", "e.*", F.get("marks", F.col("e.nth")).alias("step"), F.get("marks", F.col("notes") + F.col("e.nth")).alias("micro"))
    parts = [F.when(F.col("timed") & (F.col("step") >= 0), lookup(steps, F.col("step"), "string")), F.col("token")]
    if grid.use_microtiming:
        name = grid.nearest(grid.micro_ticks, [str(m) for m in grid.micro_ticks], F.col("micro"), min(grid.micro_ticks))
        parts.append(F.when(F.col("timed"), token("MicroTiming", name)))
    stream = Window.partitionBy(*keys).orderBy("bar", *ORDER)
    # Bars without events lie before the one that has some; they are as long as it is.
    rows = rows.withColumn("new", (F.col("bar") - F.lag("bar", 1, 0).over(stream)).cast("int"))
    rows = rows.withColumn("tokens", F.concat(F.array_repeat(F.lit("Bar_None"), F.col("new")), F.filter(F.array(*parts), lambda t: t.isNotNull())))
    rows = rows.withColumn("first", (F.sum(F.size("tokens")).over(stream) - F.size("tokens")).cast("long"))
    out = rows.select(*keys, "first", "new", "bar_tick", "length", "time", F.posexplode("tokens").alias("i", "token"))
    line = F.col("bar_tick") - (F.col("new") - 1 - F.col("i")) * F.col("length")
    return out.select(*keys, (F.col("first") + F.col("i")).alias("pos"), "token", F.when(F.col("i") < F.col("new"), line).otherwise(F.col("time")).alias("tick"))
