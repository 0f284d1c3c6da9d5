"""Hand-made scores through preprocessing, encoding, checking and decoding."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tonegrid.config import TokenizerConfig
from tonegrid.operators import controls, scores, sequences, subword, tokens
from tonegrid.operators.decode import note_pairs
from tonegrid.operators.pertok import PerTokGrid
from tonegrid.operators.scores import ScoreTables, align_signatures
from tonegrid.plans.tokenizer import Tokenizer
from tonegrid.queries import model
from tonegrid.sources.midi import compose, parse, read_midi, to_midi

NOTES = "score_id long, track_idx int, program int, time long, duration long, pitch int, velocity int"


def tables(spark, notes, tpq=8, tempos=(), signatures=(), pedals=(), bends=()):
    ids = sorted({n[0] for n in notes} | {t[0] for t in tempos})
    return ScoreTables(
        spark.createDataFrame([(i, tpq) for i in ids], "score_id long, tpq int"),
        spark.createDataFrame(notes, NOTES),
        spark.createDataFrame(list(tempos), "score_id long, seq int, time long, mspq double"),
        spark.createDataFrame(list(signatures), "score_id long, seq int, time long, num int, den int"),
        spark.createDataFrame(list(pedals), "score_id long, track_idx int, program int, time long, duration long"),
        spark.createDataFrame(list(bends), "score_id long, track_idx int, program int, time long, value int"),
    )


TRIAD = [(1, 0, 0, 0, 8, 60, 95), (1, 0, 0, 0, 8, 64, 95), (1, 0, 0, 0, 8, 67, 95), (1, 0, 0, 24, 4, 72, 99)]
CHORD = "Pitch_60 Velocity_95 Duration_1.0.8 Pitch_64 Velocity_95 Duration_1.0.8 Pitch_67 Velocity_95 Duration_1.0.8"


def line(df, column="token"):
    return [r[0] for r in df.orderBy("seq_idx", "pos").select(column).collect()]


@pytest.mark.parametrize(
    ("name", "flags", "expected"),
    [
        ("TSD", {}, f"{CHORD} TimeShift_3.0.8 Pitch_72 Velocity_99 Duration_0.4.8"),
        ("TSD", {"use_rests": True}, f"{CHORD} Rest_2.0.2 Pitch_72 Velocity_99 Duration_0.4.8"),
        ("REMI", {}, f"Bar_None Position_0 {CHORD} Position_24 Pitch_72 Velocity_99 Duration_0.4.8"),
        ("MIDILike", {}, "NoteOn_60 Velocity_95 NoteOn_64 Velocity_95 NoteOn_67 Velocity_95 TimeShift_1.0.8 NoteOff_60 NoteOff_64 NoteOff_67 TimeShift_2.0.8 NoteOn_72 Velocity_99 TimeShift_0.4.8 NoteOff_72"),
        ("Structured", {}, "TimeShift_0.0.1 " + CHORD.replace(" Pitch", " TimeShift_0.0.1 Pitch") + " TimeShift_3.0.8 Pitch_72 Velocity_99 Duration_0.4.8"),
    ],
)
def test_worked_example(spark, name, flags, expected):
    t = Tokenizer.of(name, TokenizerConfig(**flags))
    assert " ".join(line(t.encode(tables(spark, TRIAD)))) == expected


def test_worked_example_of_compound_tokens(spark):
    octuple = line(Tokenizer.of("Octuple").encode(tables(spark, TRIAD)), "tokens")
    assert octuple[0] == ["Pitch_60", "Position_0", "Bar_0", "Velocity_95", "Duration_1.0.8"] and octuple[-1] == ["Pitch_72", "Position_24", "Bar_0", "Velocity_99", "Duration_0.4.8"]
    cpword = line(Tokenizer.of("CPWord").encode(tables(spark, TRIAD)), "tokens")
    assert cpword[:3] == [["Family_Metric", "Bar_None", *["Ignore_None"] * 3], ["Family_Metric", "Position_0", *["Ignore_None"] * 3], ["Family_Note", "Ignore_None", "Pitch_60", "Velocity_95", "Duration_1.0.8"]]


def band(seed: int, n: int = 60, grid: int = 1) -> list[tuple]:
    """Drums, piano and bass on the grid, without overlaps of equal pitches."""
    rng, out = random.Random(seed), {}
    for track, program in ((0, 0), (1, 33), (2, -1)):
        for _ in range(n):
            time, pitch = grid * rng.randrange(0, 400), rng.randrange(35, 80)
            out.setdefault((program, pitch, time // 16), (1, track, program, time - time % 16 + rng.randrange(0, 2) * grid, rng.choice([1, 2, 4, 8]), pitch, rng.choice([63, 95])))
    return sorted(out.values())


FULL = {"use_programs": True, "use_tempos": True, "remove_duplicated_notes": True}
CASES = [
    ("TSD", FULL | {"use_rests": True, "use_time_signatures": True}),
    ("TSD", FULL | {"one_token_stream_for_programs": False, "use_pitch_intervals": True}),
    ("TSD", FULL | {"program_changes": True}),
    ("MIDILike", FULL | {"use_time_signatures": True}),
    ("REMI", FULL | {"use_time_signatures": True}),
    ("REMI", FULL | {"use_rests": True, "use_sustain_pedals": True, "use_pitch_bends": True}),
    ("MMM", FULL),
    ("Structured", {"use_programs": True, "remove_duplicated_notes": True}),
    ("Octuple", FULL | {"use_time_signatures": True}),
    ("CPWord", FULL | {"use_time_signatures": True}),
    ("MuMIDI", FULL),
]


@pytest.mark.parametrize(("name", "flags"), CASES)
def test_round_trip_without_errors(spark, name, flags):
    signatures = [(1, 0, 0, 4, 4), (1, 1, 64, 3, 4), (1, 2, 130, 4, 4)]
    t = tables(spark, band(3), tempos=[(1, 0, 0, 500000.0), (1, 1, 100, 600000.0)], signatures=signatures, pedals=[(1, 0, 0, 5, 20), (1, 0, 0, 25, 4), (1, 0, 0, 60, 6)], bends=[(1, 1, 33, 7, 4000)])
    tokenizer = Tokenizer.of(name, TokenizerConfig(**flags))
    ready = tokenizer.preprocess(t)
    out = tokenizer.encode(ready, preprocessed=True).cache()
    row = lambda df: sorted(tuple(r) for r in df.select("program", "time", "duration", "pitch", "velocity").collect())
    decoded = tokenizer.decode(out)
    scale = 2 if tokenizer.config.use_time_signatures else 1  # decoders count at the finest grid of the configuration
    notes = row(ready.notes)
    assert row(decoded.notes) == sorted((p, x * scale, d * scale, k, v) for p, x, d, k, v in notes)
    assert sum(r.n_errors for r in tokenizer.error_ratio(out).collect()) == 0
    again = tokenizer.tokens(tokenizer.ids(out))
    column = "tokens" if tokenizer.is_compound else "token"
    assert line(again, column) == line(out, column)
    if flags.get("use_sustain_pedals"):
        assert sorted((r.program, r.time, r.duration) for r in decoded.pedals.collect()) == [(0, 5, 24), (0, 60, 6)]
    if flags.get("use_tempos") and name not in ("Structured",):
        ticks = [r.time for r in decoded.tempos.orderBy("time").collect()]
        assert ticks[0] == 0 and len(ticks) == 2


def test_preprocessing_is_idempotent(spark):
    t = Tokenizer.of("TSD", TokenizerConfig(**FULL, use_time_signatures=True, use_sustain_pedals=True, use_pitch_bends=True))
    raw = tables(spark, [(1, k % 3, -1 if k % 3 == 2 else k % 3 * 8, k * 37, 50 + k * 11 % 900, 30 + k % 60, k % 127) for k in range(120)], tpq=480, tempos=[(1, 0, 5, 511111.0), (1, 1, 900, 700000.0)], signatures=[(1, 0, 0, 3, 4), (1, 1, 1500, 6, 8), (1, 2, 5900, 4, 4)], pedals=[(1, 0, 0, 10, 700)], bends=[(1, 1, 8, 77, -700)])
    once = t.preprocess(raw)
    twice = t.preprocess(once)
    for name in ("notes", "tempos", "time_signatures", "pedals", "pitch_bends"):
        a, b = getattr(once, name), getattr(twice, name)
        keep = [c for c in a.columns if c not in ("seq", "mspq")]
        assert sorted(map(tuple, a.select(*keep).collect())) == sorted(map(tuple, b.select(*keep).collect())), name


def test_signatures_move_to_bar_lines(spark):
    cases = [[(0, 4, 4), (10, 4, 4), (40, 3, 4), (64, 6, 8)], [(0, 4, 4), (33, 3, 4), (90, 3, 4)], [(0, 4, 4), (1, 3, 4), (2, 4, 4), (40, 2, 4)], [(5, 3, 8)], [(0, 4, 4), (0, 3, 4), (0, 4, 4)]]
    rows = [(k, i, t, n, d, 8) for k, case in enumerate(cases) for i, (t, n, d) in enumerate(case)]
    found = align_signatures(spark.createDataFrame(rows, "score_id long, seq int, time long, num int, den int, tpq int")).collect()
    got = [sorted((r.seq, r.time, r.num, r.den) for r in found if r.score_id == k) for k in range(len(cases))]
    assert [[x[1:] for x in g] for g in got] == [[(0, 4, 4), (64, 6, 8)], [(0, 4, 4), (64, 3, 4)], [(0, 4, 4), (64, 2, 4)], [(5, 3, 8)], [(0, 4, 4)]]
    assert all([x[0] for x in g] == list(range(len(g))) for g in got)


def test_pedals_that_touch_merge_and_overlaps_are_cut(spark):
    p = spark.createDataFrame([(1, 0, 0, 0, 10), (1, 0, 0, 10, 5), (1, 0, 0, 3, 2), (1, 0, 0, 20, 1)], "score_id long, track_idx int, program int, time long, duration long")
    assert sorted((r.time, r.duration) for r in scores.merge_pedals(p).collect()) == [(0, 15), (20, 1)]
    n = spark.createDataFrame([(1, 0, 0, 0, 10, 60, 90), (1, 0, 0, 6, 3, 60, 90), (1, 0, 0, 2, 9, 61, 90)], NOTES)
    assert sorted((r.pitch, r.duration) for r in scores.fix_overlaps(n).collect()) == [(60, 3), (60, 6), (61, 9)]


def test_note_pairs_are_first_in_first_out(spark):
    marks = [(0, True, 90), (3, True, 80), (5, False, 0), (9, False, 0), (9, False, 0), (12, True, 70), (15, False, 0), (20, True, 60)]
    df = spark.createDataFrame([(1, 0, 0, 60, i, t, on, v) for i, (t, on, v) in enumerate(marks)], "score_id long, seq_idx int, program int, pitch int, pos int, tick long, is_on boolean, velocity int")
    rows = lambda out: sorted((r.time, r.duration, r.velocity) for r in out.collect())
    assert rows(note_pairs(df)) == [(0, 5, 90), (3, 6, 80), (12, 3, 70)]
    assert rows(note_pairs(df, F.lit(4).cast("long"))) == [(0, 4, 90), (3, 4, 80), (12, 3, 70), (20, 4, 60)]


def test_pertok_keeps_notes_within_its_tolerance(spark):
    rng = random.Random(8)
    notes = sorted((1, 0, 0, rng.randrange(0, 9000), rng.randrange(40, 900), 40 + k % 40, 80) for k in range(80))
    for positions, micro in ((False, True), (True, True)):
        c = TokenizerConfig(use_programs=True, additional_params={"ticks_per_quarter": 320, "use_microtiming": micro, "max_microtiming_shift": 0.125, "num_microtiming_bins": 80, "use_position_toks": positions})
        t = Tokenizer.of("PerTok", c)
        found = t.decode(t.encode(tables(spark, notes, tpq=320))).notes.collect()
        assert len(found) == len(notes)
        for a, b in zip(sorted((n[5], n[3]) for n in notes), sorted((r.pitch, r.time) for r in found), strict=True):
            assert a[0] == b[0] and abs(a[1] - b[1]) <= 40
    assert PerTokGrid.of(t.config).durations[0] == (0, 40, 320)


def test_malformed_sequences_are_counted_and_let_slip(spark):
    t = Tokenizer.of("REMI", TokenizerConfig(remove_duplicated_notes=True))
    names = "Bar_None Position_4 Pitch_60 Velocity_95 Duration_1.0.8 Pitch_60 Velocity_95 Duration_1.0.8 Position_2 Pitch_62 Duration_1.0.8 Pitch_63 Velocity_95".split()
    df = spark.createDataFrame([(1, 0, i, n, 0) for i, n in enumerate(names)], "score_id long, seq_idx int, pos long, token string, tick long")
    errors = t.errors(df).where("bad_type or bad_note or bad_time").orderBy("pos").collect()
    assert [(r.pos, r.bad_type, r.bad_note, r.bad_time) for r in errors] == [(5, False, True, False), (8, False, False, True), (10, True, False, False)]
    assert {r.pitch for r in t.decode(df).notes.collect()} == {60}


def test_sequence_algebra(spark):
    t = Tokenizer.of("TSD", TokenizerConfig(use_programs=True))
    p = t.preprocess(tables(spark, band(5)))
    out = t.encode(p, preprocessed=True).cache()
    assert all(r.equal for r in sequences.equal(out, tokens.appended(tokens.sliced(out, 0, 17), tokens.sliced(out, 17))).collect())
    parts = tokens.split_at_ticks(out, t.bars(p))
    assert line(parts) == line(out) and parts.where("part > 0").count() > 0
    ids = t.ids(out)
    encoded = subword.encode_ids(ids, t.vocabulary, model(), t.bars(p))
    assert encoded.count() < ids.count() and [r.encoded for r in tokens.are_encoded(encoded, t.vocabulary).collect()] == [True]
    back = subword.decode_ids(encoded, t.vocabulary, model())
    assert [r.id for r in back.orderBy("pos").collect()] == [r.id for r in ids.orderBy("pos").collect()]
    with pytest.raises(Exception, match="not in the vocabulary"):
        t.ids(out.withColumn("token", F.lit("Nothing_1"))).collect()


def test_subword_merges_by_rank():
    m = subword.SubwordModel.from_json('{"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "abab": 3, "ba": 4}, "merges": [["a", "b"], "ab ab", ["b", "a"]]}}')
    assert m.encode("ababa") == [3, 0] and m.encode("ba") == [4] and m.encode("") == []


def test_controls_of_an_empty_bar(spark):
    c = TokenizerConfig(use_programs=True, ac_note_density_track=True, ac_polyphony_bar=True, one_token_stream_for_programs=False)
    t = Tokenizer.of("TSD", c)
    p = t.preprocess(tables(spark, [(1, 0, 0, 0, 4, 60, 90), (1, 0, 0, 0, 4, 64, 90), (1, 0, 0, 70, 4, 60, 90)]))
    found = {(r.bar, r.token) for r in controls.controls(p.notes, t.bars(p), t.config).collect()}
    assert (None, "ACTrackNoteDensityMin_0") in found and (None, "ACTrackNoteDensityMax_2") in found and (0, "ACBarOnsetPolyphonyMax_2") in found


def test_own_control_in_the_stream(spark):
    c = TokenizerConfig(use_programs=True, ac_note_density_bar=True, one_token_stream_for_programs=False)
    longest = lambda n, b, c: n.groupBy("score_id", "track_idx", "bar").agg(F.concat(F.lit("ACBarLongest_"), F.max("duration")).alias("token"))
    t = Tokenizer.of("TSD", c).with_control(controls.Control(tuple(f"ACBarLongest_{i}" for i in range(100)), longest))
    p = t.preprocess(tables(spark, [(1, 0, 0, 0, 4, 60, 90), (1, 0, 0, 40, 6, 60, 90), (1, 1, 5, 0, 4, 60, 90)]))
    request = spark.createDataFrame([(1, 0, 0, [0]), (1, 0, 1, None), (1, 1, 1, [7])], "score_id long, track_idx int, control int, bars array<long>")
    out = t.ids(t.encode(p, preprocessed=True, request=request))
    found = [(r.seq_idx, r.token) for r in out.orderBy("seq_idx", "pos").collect() if r.token.startswith("AC")]
    assert found == [(0, "ACBarNoteDensity_1"), (0, "ACBarLongest_4"), (0, "ACBarLongest_6")]
    with pytest.raises(ValueError):
        Tokenizer.of("Octuple").with_control(t.controls[0])


def test_subword_marks(spark):
    m = subword.SubwordModel.from_json(
        '{"pre_tokenizer": {"type": "Metaspace", "replacement": "_"}, "model": {"continuing_subword_prefix": "#", "end_of_word_suffix": "$", '
        '"vocab": {"_": 0, "#a": 1, "#b$": 2, "#ab$": 3, "_ab$": 4, "#a$": 5}, "merges": [["#a", "#b$"], ["_", "#ab$"]]}}'
    )
    assert m.encode("ab") == [4] and m.encode("aab") == [0, 1, 3] and m.encode("") == [] and m.plain("_ab$") == "ab"
    v = Tokenizer.of("TSD").vocabulary
    unknown = spark.createDataFrame([(1, 0, 0, 77)], "score_id long, seq_idx int, pos long, id int")
    with pytest.raises(Exception, match="not a piece"):
        subword.decode_ids(unknown, v, m).collect()


def test_subword_split_by_track(spark):
    """Merges stay within a bar of a track, and the tracks of a concatenated sequence keep their order."""
    t = Tokenizer.of("MMM", TokenizerConfig(use_programs=True))
    p = t.preprocess(tables(spark, [(1, 0, 0, 0, 4, 60, 90), (1, 0, 0, 40, 4, 62, 90), (1, 1, 5, 0, 4, 64, 90), (1, 1, 5, 40, 4, 65, 90)]))
    ids = t.ids(t.encode(p, preprocessed=True))
    byte = lambda name: t.vocabulary.byte_of(t.vocabulary.id_of(name))
    pairs = ((byte("Track_End"), byte("Track_Start")), (byte("Track_Start"), byte("Program_0")))
    pieces = {t.vocabulary.byte_of(i): i for i in range(t.vocabulary.sizes[0])}
    for a, b in pairs:
        pieces[a + b] = len(pieces)
    m = subword.SubwordModel(pieces, pairs)
    encoded = subword.encode_ids(ids, t.vocabulary, m, t.bars(p))
    found = [r.id for r in encoded.orderBy("pos").collect()]
    assert pieces[pairs[1][0] + pairs[1][1]] in found and pieces[pairs[0][0] + pairs[0][1]] not in found
    back = subword.decode_ids(encoded, t.vocabulary, m)
    assert [r.id for r in back.orderBy("pos").collect()] == [r.id for r in ids.orderBy("pos").collect()]


@pytest.mark.parametrize("name", ["MIDILike", "MMM"])
def test_controls_come_first(spark, name):
    c = TokenizerConfig(use_programs=True, ac_polyphony_track=True, ac_note_density_bar=True, one_token_stream_for_programs=False)
    t = Tokenizer.of(name, c)
    p = t.preprocess(tables(spark, [(1, 0, 0, 0, 4, 60, 90), (1, 1, 5, 40, 4, 64, 90), (1, 1, 5, 40, 4, 65, 90)]))
    out = t.encode(p, preprocessed=True, request=controls.asked_of_all(p.notes, {0: None, 1: None}))
    found = [r.token for r in out.orderBy("seq_idx", "pos").collect() if r.token.startswith("AC")]
    assert found == [f"{n}_{k}" for k in (1, 2) for n in ("ACTrackOnsetPolyphonyMin", "ACTrackOnsetPolyphonyMax", "ACBarNoteDensity")]
    assert t.ids(out).count() == out.count()


def test_sequence_equality_needs_a_shared_attribute(spark):
    a = spark.createDataFrame([(1, 0, 0, "x"), (2, 0, 0, None)], "score_id long, seq_idx int, pos long, token string")
    b = spark.createDataFrame([(1, 0, 0, "x", 5), (2, 0, 0, "x", 5)], "score_id long, seq_idx int, pos long, token string, id int")
    assert {r.score_id: r.equal for r in sequences.equal(a, b).collect()} == {1: True, 2: False}
    assert {r.score_id: r.size for r in sequences.sizes(a).collect()} == {1: 1, 2: 0}


def test_midi_round_trip(spark, tmp_path):
    notes = [(1, 0, 0, 0, 240, 60, 90), (1, 0, 0, 100, 240, 60, 80), (1, 1, 33, 480, 120, 40, 70), (1, 2, -1, 0, 60, 36, 100)]
    t = tables(spark, notes, tpq=480, tempos=[(1, 0, 0, 500000.0), (1, 1, 960, 600000.0)], signatures=[(1, 0, 0, 6, 8)], pedals=[(1, 0, 0, 10, 400)], bends=[(1, 1, 33, 480, -8192)])
    content = to_midi(t).collect()[0].content
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.MID").write_bytes(bytes(content))
    (tmp_path / "a" / "notes.txt").write_text("no music")
    r = read_midi(spark, str(tmp_path))
    got = lambda df, *c: sorted(tuple(x) for x in df.select(*c).collect())
    assert got(r.notes, "program", "time", "duration", "pitch", "velocity") == sorted(n[2:] for n in notes)
    assert got(r.tempos, "time", "mspq") == [(0, 500000.0), (960, 600000.0)] and got(r.time_signatures, "time", "num", "den") == [(0, 6, 8)]
    assert got(r.pedals, "program", "time", "duration") == [(0, 10, 400)] and got(r.pitch_bends, "program", "time", "value") == [(33, 480, -8192)]
    assert got(r.scores, "tpq") == [(480,)]


def test_midi_defaults_and_bad_files():
    rows = parse(compose(96, [("note", 0, 0, 0, 10, 60, 64, None)]))
    assert {(r[0], r[4]) for r in rows if r[0] in ("tempo", "signature")} == {("tempo", 0), ("signature", 0)}
    with pytest.raises(ValueError):
        parse(b"RIFF1234")
