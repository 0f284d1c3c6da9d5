"""Octuple: sections that begin with bars without notes."""

from __future__ import annotations

import pytest

from tonegrid.config import TokenizerConfig
from tonegrid.grids import Grids
from tonegrid.operators.scores import ScoreTables
from tonegrid.plans.tokenizer import Tokenizer


def test_bars_without_notes_belong_to_their_section(spark):
    """A bar of 4/4 with a note, an empty one of 3/4, one with a note."""
    c = TokenizerConfig(use_programs=True, use_time_signatures=True)
    notes = spark.createDataFrame([(1, 0, 0, 0, 480, 60, 99), (1, 0, 0, 3360, 480, 62, 99)], "score_id long, track_idx int, program int, time long, duration long, pitch int, velocity int")
    signatures = spark.createDataFrame([(1, 0, 0, 4, 4), (1, 1, 1920, 3, 4)], "score_id long, seq int, time long, num int, den int")
    t = Tokenizer.of("Octuple", c)
    p = t.preprocess(ScoreTables(spark.createDataFrame([(1, 480)], "score_id long, tpq int"), notes, time_signatures=signatures))
    out = t.encode(p, preprocessed=True)
    beat = Grids(t.config).ticks_per_beat[4]
    found = t.decode(out, sections=p.sections)
    assert sorted((n.time, n.pitch) for n in found.notes.collect()) == [(0, 60), (7 * beat, 62)]
    assert sorted((s.time, s.num) for s in found.time_signatures.collect()) == [(0, 4), (4 * beat, 3)]
    # The tokens alone don't tell whose the empty bar is.
    assert sorted(n.time for n in t.decode(out).notes.collect()) == [0, 8 * beat]
    with pytest.raises(ValueError):
        Tokenizer.of("REMI", c).decode(out, sections=p.sections)
