"""The value grids that a configuration spans: velocities, durations, rests, tempos, bends, signatures."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from .config import TokenizerConfig

Span = tuple[int, int, int]  # beats, positions, positions per beat


def half_even(x: float) -> int:
    """Nearest integer, halves to the even one (as Python's round does)."""
    return round(x)


def two_decimals(x: float) -> str:
    """Two decimals, of which one trailing zero is dropped: 120.0, 46.77, 52.5."""
    text = f"{x:.2f}"
    return text[:-1] if text.endswith("0") else text


def nearest(bins: Sequence, x) -> int:
    """The nearest of the rising ``bins``; of two as near the larger."""
    i = bisect_left(bins, x)
    if i == 0:
        return bins[0]
    return bins[i] if i < len(bins) and bins[i] - x <= x - bins[i - 1] else bins[i - 1]


def spans(resolution: dict[tuple[int, int], int]) -> list[Span]:
    """All positive (beats, positions, resolution) of the ranges, and the end of the last one."""
    out = [(beat, pos, res) for (lo, hi), res in sorted(resolution.items()) for beat in range(lo, hi) for pos in range(res)]
    (_, end), res = max(resolution.items(), key=lambda x: x[0][1])
    return [s for s in [*out, (end, 0, res)] if s[0] or s[1]]


def span_name(span: Span) -> str:
    return ".".join(map(str, span))


def span_ticks(span: Span, ticks_per_beat: int) -> int:
    beats, pos, res = span
    return (beats * res + pos) * ticks_per_beat // res


@dataclass(frozen=True)
class TickTable:
    """A list of spans as ticks at one number of ticks per beat, and the tables derived from it."""

    names: tuple[str, ...]
    ticks: tuple[int, ...]

    @property
    def longest(self) -> int:
        return max(self.ticks)

    @property
    def shortest(self) -> int:
        return self.ticks[0]

    @cached_property
    def name_of(self) -> dict[int, str]:
        """Ticks to name; of spans with equal ticks the last."""
        return dict(zip(self.ticks, self.names, strict=True))

    @cached_property
    def nearest_ticks(self) -> list[int]:
        """For each number of ticks up to the longest span: the nearest span's ticks."""
        rising = sorted(set(self.ticks))
        return [nearest(rising, x) for x in range(self.longest + 1)]

    @cached_property
    def greedy(self) -> list[list[str]]:
        """For each number of ticks below the longest span: the spans that fill it, largest first."""
        rising = sorted(self.name_of)
        out: list[list[str]] = []
        for x in range(self.longest):
            fit = [t for t in rising if t <= x]
            out.append([self.name_of[fit[-1]], *out[x - fit[-1]]] if fit and x >= self.shortest else [])
        return out

    @cached_property
    def greedy_left(self) -> list[int]:
        """What the greedy spans leave of each number of ticks below the longest span."""
        of = {n: t for t, n in self.name_of.items()}
        return [x - sum(of[n] for n in names) for x, names in enumerate(self.greedy)]


@dataclass(frozen=True)
class Grids:
    """Everything derived from a configuration by arithmetic; small, driver-side, sent as literals."""

    config: TokenizerConfig

    @cached_property
    def velocities(self) -> list[int]:
        n = self.config.num_velocities
        return [127 * i // n for i in range(1, n + 1)]

    @cached_property
    def velocity_table(self) -> list[int]:
        """Velocity 0 to 127 to its bin."""
        return [nearest(self.velocities, v) for v in range(128)]

    @cached_property
    def durations(self) -> list[Span]:
        return spans(self.config.beat_res)

    @cached_property
    def rests(self) -> list[Span]:
        return spans(self.config.beat_res_rest)

    @cached_property
    def time_signatures(self) -> list[tuple[int, int]]:
        if not self.config.use_time_signatures:
            return [(4, 4)]
        return [(n, d) for d, numerators in self.config.time_signature_range for n in numerators]

    @cached_property
    def tempos(self) -> list[float]:
        (lo, hi), n = self.config.tempo_range, self.config.num_tempos
        steps = [i / max(n - 1, 1) for i in range(n)]
        if self.config.log_tempos:
            a, b = math.log10(lo), math.log10(hi)
            return [half_even(10 ** (a + (b - a) * s) * 100) / 100 for s in steps]
        return [half_even((lo + (hi - lo) / max(n - 1, 1) * i) * 100) / 100 for i in range(n)]

    @cached_property
    def default_tempo(self) -> float:
        """120, or with tempos in use the nearest one on the grid (the lower of two as near)."""
        if not self.config.use_tempos:
            return 120.0
        return min(self.tempos, key=lambda t: abs(t - 120.0))

    @cached_property
    def pitch_bends(self) -> list[int]:
        lo, hi, n = self.config.pitch_bend_range
        return [math.floor(lo + (hi - lo) / (n - 1) * i) for i in range(n)] if n > 1 else [lo]

    @property
    def positions_per_beat(self) -> int:
        return self.config.max_positions_per_beat

    @cached_property
    def positions(self) -> int:
        """Positions of the longest bar."""
        return self.positions_per_beat * max(n for n, _ in self.time_signatures)

    @cached_property
    def ticks_per_beat(self) -> dict[int, int]:
        """Denominator to ticks per beat when every position is at least a tick."""
        largest = max(d for _, d in self.time_signatures)
        return {d: self.positions_per_beat * largest // d for _, d in self.time_signatures}

    def tick_table(self, ticks_per_beat: int, rest: bool = False) -> TickTable:
        of = self.rests if rest else self.durations
        return TickTable(tuple(map(span_name, of)), tuple(span_ticks(s, ticks_per_beat) for s in of))

    @cached_property
    def possible_ticks_per_beat(self) -> list[int]:
        """Ticks per beat that a preprocessed score can have in some section."""
        if not self.config.use_time_signatures:
            return [self.positions_per_beat]
        denominators = {d for _, d in self.time_signatures} | {4}
        # A score's resolution follows from its finest denominator.
        pairs = [(finest, d) for finest in denominators for d in denominators if d <= finest]
        return sorted({self.positions_per_beat * finest // d for finest, d in pairs})
