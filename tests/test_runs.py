"""Streams are laid out by runs of events, several times fewer rows than events."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tonegrid import fixtures
from tonegrid import queries as music
from tonegrid.functions import token
from tonegrid.operators import events, scores, timing

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "fewer"), [("TSD", 3), ("REMI", 3), ("MIDILike", 2)])
def test_runs_hold_the_events_in_order(spark, name, fewer):
    t = music.tokenizer(name, **music.FULL)
    p = t.preprocess(fixtures.score_tables(spark, DATA))
    key = F.struct(*events.ORDER)
    lists = lambda rows: {r.score_id: r.x for r in rows.collect()}
    single = events.events(p, t.config, t.note_on_off).cache()
    runs = events.runs(p, t.config, t.note_on_off).cache()
    expected = lists(single.groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), token(F.col("type"), F.col("value")).alias("t")))), lambda x: x.t).alias("x")))
    found = lists(runs.groupBy("score_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "tokens"))), lambda x: x.tokens)).alias("x")))
    assert found == expected
    assert runs.count() * fewer < single.count() * 1.2


@pytest.mark.parametrize("name", ["TSD", "REMI", "MIDILike"])
def test_runs_and_events_give_the_same_tokens(spark, name):
    t = music.tokenizer(name, **music.FULL)
    p = t.preprocess(fixtures.score_tables(spark, DATA))
    lay = {"TSD": timing.tsd, "REMI": timing.remi, "MIDILike": timing.midilike}[name]
    of = lambda rows: sorted(map(tuple, lay(rows, p, t.config).select("score_id", "seq_idx", "pos", "token", "tick").collect()))
    assert of(events.runs(p, t.config, t.note_on_off)) == of(events.events(p, t.config, t.note_on_off))


def test_sections_are_not_joined_to_runs(spark):
    """Each row has the section of the last signature before it, in the window that it goes through anyway."""
    rows = spark.createDataFrame([], f"score_id long, seq_idx int, time long, cls int, track int, src int, seq long, sub int, type string, tokens array<string>, program int, note_end long, section {scores.SECTION}")
    sections = spark.createDataFrame([], f"score_id long, sections array<{scores.SECTION}>")
    out = timing.tsd(rows, scores.ScoreTables(rows, rows, sections=sections), music.tokenizer("TSD", **music.FULL).config)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
