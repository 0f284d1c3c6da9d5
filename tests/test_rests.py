"""The clock of rests as a running sum: rows are made once, and ends before the last rest don't count twice."""

from __future__ import annotations

import random

from tests.test_maxplus import walked
from tonegrid.config import TokenizerConfig
from tonegrid.operators import decode

C = TokenizerConfig(use_rests=True, use_programs=True)


def test_rows_are_made_once(spark):
    """Before, tokens were made nine times over: for the clock, and twice at each level of a scan."""
    tokens = spark.createDataFrame([(1, 0, 0, "Rest_1.0.4")], "score_id long, seq_idx int, pos long, token string").repartition(3, "score_id")
    plan = decode.rested_shifts(tokens, C, ("Program",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_long_and_short_ends_between_rests(spark):
    rng = random.Random(3)
    note = lambda: ["Pitch_60", "Velocity_99", f"Duration_{rng.choice(['12.0.4', '5.0.4', '0.1.8', '2.4.8'])}"]
    some = [note, note, lambda: ["Rest_0.1.8"], lambda: ["Rest_0.4.8"], lambda: ["TimeShift_0.1.8"], lambda: ["TimeShift_4.0.4"], lambda: ["Program_1"]]
    streams = [["Rest_0.1.8", *note()], [*note(), "Rest_0.1.8", "Rest_0.1.8"]] + [[t for _ in range(300) for t in rng.choice(some)()] for _ in range(12)]
    rows = [(k % 3, k, i, t) for k, s in enumerate(streams) for i, t in enumerate(s)]
    tokens = spark.createDataFrame(rows, "score_id long, seq_idx int, pos long, token string")
    found = {(r.seq_idx, r.pos): r.tick for r in decode.rested_shifts(tokens, C, ("Program",)).collect()}
    assert found == {(k, i): t for k, s in enumerate(streams) for i, t in enumerate(walked(s, C))}
