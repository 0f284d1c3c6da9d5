"""The scan of max-plus matrices, and the clock of rests that it gives, against a loop."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from tonegrid.config import TokenizerConfig
from tonegrid.grids import Grids
from tonegrid.operators import decode, maxplus


@pytest.mark.parametrize("blocks", [(), (3,), (4, 2), (256, 4096)])
def test_scan(spark, blocks):
    rng = random.Random(1)
    rows = [(k, n, *(rng.choice((maxplus.NEVER, rng.randrange(-9, 9))) for _ in range(4))) for k in range(3) for n in range(0, 60, 1 + k) if k or n not in range(12, 30)]
    frame = spark.createDataFrame(rows, "k int, n long, ll long, le long, el long, ee long").select("k", "n", maxplus.matrix(*map(F.col, ("ll", "le", "el", "ee"))).alias("m"))
    never = lambda x: max(x, maxplus.NEVER)
    expected, states = {}, {}
    for k, n, ll, le, el, ee in rows:
        lift, end = states.get(k, (0, maxplus.NEVER))
        states[k] = expected[k, n] = (never(max(lift + ll, end + le)), never(max(lift + el, end + ee)))
    found = {(r.k, r.n): (r.state.lift, r.state.end) for r in maxplus.scan(frame, ["k"], blocks).collect()}
    real = lambda states: {k: tuple(x if x > maxplus.NEVER // 2 else None for x in v) for k, v in states.items()}
    assert real(found) == real(expected)


def walked(tokens, c):
    """Ticks of a stream, rests from the latest end."""
    g = Grids(c)
    spans, rests = (dict(zip(t.names, t.ticks, strict=True)) for t in (g.tick_table(8), g.tick_table(8, rest=True)))
    tick = end = 0
    out = []
    for i, t in enumerate(tokens):
        kind, value = t.split("_")
        if kind == "TimeShift":
            tick += spans[value]
        elif kind == "Rest":
            tick = max(tick, end) + rests[value]
        if kind == "Pitch" and i + 2 < len(tokens) and tokens[i + 2].startswith("Duration"):
            end = max(end, tick + spans[tokens[i + 2].split("_")[1]])
        elif kind == "Program":
            end = max(end, tick)
        out.append(tick)
    return out


def test_rests_in_any_order(spark):
    c = TokenizerConfig(use_rests=True, use_programs=True)
    rng = random.Random(2)
    choices = [["Pitch_60", "Velocity_99", "Duration_2.0.8"], ["Pitch_60", "Velocity_99", "Duration_0.3.8"], ["Rest_1.0.4"], ["Rest_0.2.8", "Rest_0.1.8"], ["TimeShift_0.4.8"], ["Program_3"], ["Pitch_61", "Duration_1.0.8"], ["Pitch_62"]]
    streams = [[t for _ in range(n) for t in rng.choice(choices)] for n in (1, 5, 200, 700, 1500)] + [["Rest_1.0.4"] * 600, ["Program_1"]]
    rows = [(1, k, i, t) for k, s in enumerate(streams) for i, t in enumerate(s)]
    tokens = spark.createDataFrame(rows, "score_id long, seq_idx int, pos long, token string")
    marking = ("Program",)
    found = {(r.seq_idx, r.pos): r.tick for r in decode.rested_shifts(tokens, c, marking).collect()}
    assert found == {(k, i): t for k, s in enumerate(streams) for i, t in enumerate(walked(s, c))}
