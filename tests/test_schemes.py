"""A tenth tokenizer, registered from outside the package, and tokens decoded to files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonegrid.config import TokenizerConfig
from tonegrid.operators import decode
from tonegrid.operators.scores import ScoreTables
from tonegrid.plans import tokenizer as plans
from tonegrid.plans.tokenizer import Scheme, Tokenizer, register
from tonegrid.sources.midi import read_midi

NOTE = "score_id long, track_idx int, program int, time long, duration long, pitch int, velocity int"


def encode(tables, c):
    """``Step_gap`` and ``Pitch_n`` of each note, all as long as a position."""
    order = Window.partitionBy("score_id").orderBy("time", "pitch")
    rows = tables.notes.withColumns({"gap": F.col("time") - F.lag("time", 1, 0).over(order), "n": F.row_number().over(order) - 1})
    two = F.array(F.concat(F.lit("Step_"), "gap"), F.concat(F.lit("Pitch_"), "pitch"))
    out = rows.select("score_id", F.lit(0).alias("seq_idx"), "n", "time", F.posexplode(two).alias("i", "token"))
    return out.select("score_id", "seq_idx", (F.col("n") * 2 + F.col("i")).cast("long").alias("pos"), "token", F.col("time").alias("tick"))


def decoded(tokens, c):
    rows = decode.parsed(tokens)
    step = F.when(F.col("type") == "Step", F.col("value").cast("long"))
    rows = rows.withColumn("tick", F.sum(F.coalesce(step, F.lit(0))).over(decode.before()))
    notes = rows.where("type = 'Pitch'").select("score_id", "seq_idx", F.lit(0).alias("program"), F.col("tick").alias("time"), F.lit(1).cast("long").alias("duration"), F.col("value").cast("int").alias("pitch"), F.lit(100).alias("velocity"))
    return decode._only_notes(notes)


STEPS = Scheme(vocabulary=lambda c: [f"Step_{i}" for i in range(64)] + [f"Pitch_{p}" for p in range(*c.pitch_range)], encode=encode, decode=decoded)


@pytest.fixture
def steps():
    register("Steps", STEPS)
    yield "Steps"
    plans.SCHEMES.pop("Steps")


def tables(spark):
    notes = [(7, 0, 0, 240 * k, 240, 60 + k % 5, 90) for k in range(20)]
    return ScoreTables(spark.createDataFrame([(7, 480)], "score_id long, tpq int"), spark.createDataFrame(notes, NOTE))


def test_a_registered_tokenizer(spark, steps):
    t = Tokenizer.of(steps, TokenizerConfig(pitch_range=(50, 70)))
    assert t.vocabulary.sizes == [4 + 64 + 20] and not t.is_compound and t.io_format == ("I", "T")
    out = t.encode(tables(spark))
    ids = t.ids(out)
    assert [r.token for r in out.orderBy("pos").limit(4).collect()] == ["Step_0", "Pitch_60", "Step_4", "Pitch_61"]
    notes = t.decode(ids.select("score_id", "seq_idx", "pos", "id")).notes
    assert sorted((r.time, r.pitch) for r in notes.collect()) == sorted((4 * k, 60 + k % 5) for k in range(20))
    with pytest.raises(ValueError, match="no type graph"):
        t.errors(out)
    own = Scheme(**(vars(STEPS) | {"errors": lambda tokens, c: tokens.select("score_id", "seq_idx", "pos", F.col("token").startswith("Step_4").alias("bad_type"), *(F.lit(False).alias(n) for n in ("bad_note", "bad_time")))}))
    register("Steps", own)
    assert t.error_counts(out).first().n_errors == 19


def test_what_is_checked(steps):
    for name, scheme, kind in [
        ("REMI", STEPS, ValueError),
        ("", STEPS, ValueError),
        ("X", Scheme(**(vars(STEPS) | {"encode": None})), TypeError),
        ("X", Scheme(**(vars(STEPS) | {"vocabulary": lambda c: []})), ValueError),
        ("X", Scheme(**(vars(STEPS) | {"vocabulary": lambda c: ["Pitch_1", "Pitch_1"]})), ValueError),
        ("X", Scheme(**(vars(STEPS) | {"vocabulary": lambda c: ["Pitch"]})), ValueError),
    ]:
        with pytest.raises(kind):
            register(name, scheme)
    with pytest.raises(ValueError, match="Steps"):
        Tokenizer.of("Unknown")


@pytest.mark.parametrize("name", ["TSD", "REMI", "MIDILike", "Octuple", "PerTok"])
def test_decoding_to_files(spark, tmp_path, name):
    params = {"additional_params": {"ticks_per_quarter": 480, "use_microtiming": False, "max_microtiming_shift": 0.125, "num_microtiming_bins": 80, "use_position_toks": False}} if name == "PerTok" else {}
    t = Tokenizer.of(name, TokenizerConfig(use_programs=True, use_tempos=name == "REMI", **params))
    out = t.encode(tables(spark))
    t.save_midi(out, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["7.mid"]
    r = read_midi(spark, str(tmp_path / "out"))
    unit = r.scores.first().tpq / 480
    found = sorted((n.time / unit, n.pitch, n.velocity) for n in r.notes.collect())
    assert found == sorted((240 * k, 60 + k % 5, 91) for k in range(20))
    assert r.tempos.count() == 1 and r.time_signatures.count() == 1
    assert {n.program for n in r.notes.collect()} == {0}
