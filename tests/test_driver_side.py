"""Configuration, grids, vocabularies and graphs."""

from __future__ import annotations

import pytest

from tonegrid.config import TokenizerConfig, special_token
from tonegrid.graph import type_graph
from tonegrid.grids import Grids, nearest, two_decimals
from tonegrid.plans.tokenizer import Tokenizer
from tonegrid.vocabulary import NAMES, Vocabulary, adapted, type_of


def test_special_tokens_have_one_underscore():
    assert [special_token(x) for x in ("PAD", "Genre_Rock", "a_b_c")] == ["PAD_None", "Genre_Rock", "a-b_c"]
    c = TokenizerConfig(special_tokens=("X", "X_None", "EOS"))
    assert c.special_tokens == ("X_None", "EOS_None", "PAD_None")


def test_config_round_trip(tmp_path):
    c = TokenizerConfig(use_programs=True, program_changes=True, beat_res={(0, 2): 4}, beat_res_rest={(0, 2): 2}, chord_unknown=(3, 5), programs=(0, 5, -1), additional_params={"max_duration": [1, 0, 4]})
    c.save(str(tmp_path / "c.json"))
    assert TokenizerConfig.load(str(tmp_path / "c.json")) == c


def test_contradictory_flags_are_resolved():
    c = TokenizerConfig(program_changes=True, sustain_pedal_duration=True, use_rests=True, use_note_duration_programs=(0,))
    assert not (c.program_changes or c.sustain_pedal_duration or c.use_rests or c.one_token_stream_for_programs)
    for bad in ({"pitch_range": (60, 60)}, {"num_velocities": 0}, {"max_pitch_interval": 200}, {"use_time_signatures": True, "time_signature_range": {"3": [4]}}, {"use_rests": True, "beat_res_rest": {(0, 1): 16}}):
        with pytest.raises(ValueError):
            TokenizerConfig(**bad)


def test_grids():
    g = Grids(TokenizerConfig(use_tempos=True))
    assert g.velocities[:3] + g.velocities[-1:] == [3, 7, 11, 127] and len(g.durations) == 64 and len(g.rests) == 32
    assert g.velocity_table[5] == 7 and nearest([1, 3], 2) == 3
    assert g.tempos[:2] == [40.0, 46.77] and two_decimals(120) == "120.0" and two_decimals(46.77) == "46.77" and two_decimals(52.5) == "52.5"
    t = g.tick_table(8)
    assert t.ticks[:3] == (1, 2, 3) and t.longest == 96 and t.greedy[35] == ["4.1.4", "0.1.8"] and t.greedy_left[35] == 0


@pytest.mark.parametrize(("name", "size"), [("REMI", 282), ("TSD", 313), ("MIDILike", 398), ("Structured", 314)])
def test_default_vocabulary_sizes(name, size):
    assert len(Tokenizer.of(name).vocabulary) == size


@pytest.mark.parametrize("name", NAMES)
def test_vocabularies_are_dense_and_start_with_specials(name):
    c = adapted(name, TokenizerConfig(use_programs=True, use_tempos=True, use_time_signatures=True, use_chords=True, use_rests=True, use_sustain_pedals=True, use_pitch_bends=True, use_pitch_intervals=True))
    v = Vocabulary.of(name, c)
    for part, ids in zip(v.parts, v.ids, strict=True):
        assert part[: len(c.special_tokens)] == c.special_tokens and sorted(ids.values()) == list(range(len(part)))
    more = v.with_tokens("Genre_Rock", special=True)
    assert more.id_of("Genre_Rock") == v.sizes[0] and more.special_ids[-1] == v.sizes[0]
    graph = type_graph(name, c)
    if graph:
        kinds = {type_of(t) for p in v.parts for t in p}
        assert {b for targets in graph.values() for b in targets} <= kinds | {"Ignore"}
        assert graph["EOS"] == set() and all("BOS" not in graph[k] for k in graph if k not in set(map(type_of, c.special_tokens)))


def test_core_edges():
    g = type_graph("TSD", adapted("TSD", TokenizerConfig()))
    core = lambda k: g[k] - {"PAD", "MASK", "EOS"}
    assert core("Pitch") == {"Velocity"} and core("Velocity") == {"Duration"} and core("Duration") == core("TimeShift") == {"Pitch", "PitchDrum", "TimeShift"}
    g = type_graph("REMI", adapted("REMI", TokenizerConfig(use_time_signatures=True)))
    assert g["Bar"] - {"PAD", "MASK", "EOS"} == {"TimeSig"} and "Position" in g["TimeSig"]


def test_io_formats():
    assert Tokenizer.of("TSD").io_format == ("I", "T")
    assert Tokenizer.of("Octuple", TokenizerConfig(use_programs=True)).io_format == ("T", "C")
    assert Tokenizer.of("MMM").io_format == ("T",)
    with pytest.raises(ValueError):
        Tokenizer.of("Nothing")
