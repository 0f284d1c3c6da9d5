"""Vocabularies of the nine tokenizers, and the ids, bytes and types of their tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .config import PITCH_CLASSES, TokenizerConfig
from .grids import Grids, span_name, two_decimals

NOTE_ON_OFF = {"MIDILike"}
COMPOUND = {"Octuple", "CPWord", "MuMIDI"}
NAMES = ("REMI", "TSD", "MIDILike", "MMM", "Structured", "Octuple", "MuMIDI", "CPWord", "PerTok")
#: Code point of the byte of id 0; before it lie control characters and the blank.
FIRST_BYTE = 33


def adapted(name: str, config: TokenizerConfig) -> TokenizerConfig:
    """The configuration with what the tokenizer can't express switched off, and its own parameters set."""
    params = dict(config.additional_params)
    off = lambda *flags: dict.fromkeys(flags, False)
    no_controls = off(*(f for f in TokenizerConfig.__dataclass_fields__ if f.startswith("ac_") and f.rsplit("_", 1)[1] in ("track", "bar")))
    change: dict = {}
    if name == "REMI":
        params = {"max_bar_embedding": None, "use_bar_end_tokens": False, "add_trailing_bars": False} | params
    elif name == "Structured":
        change = off("use_chords", "use_rests", "use_tempos", "use_time_signatures", "use_sustain_pedals", "use_pitch_bends", "use_pitch_intervals", "program_changes") | no_controls
    elif name == "CPWord":
        change = off("use_sustain_pedals", "use_pitch_bends", "use_pitch_intervals", "program_changes") | no_controls
        if not set(config.programs) <= set(config.use_note_duration_programs):
            change["use_note_duration_programs"] = ()
    elif name == "Octuple":
        params = {"max_bar_embedding": 60} | params
        change = off("use_rests", "use_sustain_pedals", "use_pitch_bends", "use_pitch_intervals", "program_changes") | no_controls
        change |= {"delete_equal_successive_tempo_changes": True}
    elif name == "MuMIDI":
        params = {"max_bar_embedding": 60} | params
        change = off("use_rests", "use_time_signatures", "use_sustain_pedals", "use_pitch_bends", "use_pitch_intervals", "program_changes") | no_controls
        change |= {"use_programs": True, "one_token_stream_for_programs": True}
    elif name == "MMM":
        params = {"base_tokenizer": "TSD"} | params
        if params["base_tokenizer"] not in ("REMI", "TSD", "MIDILike"):
            raise ValueError(f"MMM can't build on {params['base_tokenizer']}")
        tokens = dict.fromkeys([*config.special_tokens, "Track_Start", "Track_End"])
        change = {"use_programs": True, "program_changes": True, "one_token_stream_for_programs": False, "special_tokens": tuple(tokens)}
        return adapted(params["base_tokenizer"], config.with_(**change, additional_params=params))
    elif name == "PerTok":
        params = {"ticks_per_quarter": 320, "use_microtiming": False, "use_position_toks": False} | params
        if params["use_microtiming"]:
            params = {"max_microtiming_shift": 0.125, "num_microtiming_bins": 30} | params
    if name in COMPOUND or config.one_token_stream_for_programs:
        change |= no_controls  # attribute controls stand in streams of one track only
    return config.with_(**change, additional_params=params)


def _numbered(prefix: str, values: Iterable) -> list[str]:
    return [f"{prefix}_{v}" for v in values]


class Lists:
    """Token lists by type, from which the vocabularies are put together."""

    def __init__(self, config: TokenizerConfig, note_on_off: bool) -> None:
        self.c, self.g, self.on_off = config, Grids(config), note_on_off

    @property
    def pitches(self) -> range:
        return range(*self.c.pitch_range)

    @property
    def drums(self) -> range:
        return range(*self.c.drums_pitch_range)

    @property
    def durations(self) -> list[str]:
        return _numbered("Duration", map(span_name, self.g.durations))

    @property
    def shifts(self) -> list[str]:
        return _numbered("TimeShift", map(span_name, self.g.durations))

    @property
    def rests(self) -> list[str]:
        return _numbered("Rest", map(span_name, self.g.rests))

    @property
    def velocities(self) -> list[str]:
        return _numbered("Velocity", self.g.velocities)

    @property
    def positions(self) -> list[str]:
        return _numbered("Position", range(self.g.positions))

    @property
    def tempos(self) -> list[str]:
        return _numbered("Tempo", map(two_decimals, self.g.tempos))

    @property
    def signatures(self) -> list[str]:
        return [f"TimeSig_{n}/{d}" for n, d in self.g.time_signatures]

    @property
    def programs(self) -> list[str]:
        return _numbered("Program", self.c.programs)

    @property
    def chords(self) -> list[str]:
        qualities = [q for q, _ in self.c.chord_maps]
        if self.c.chord_unknown:
            qualities += [f"ukn{n}" for n in range(*self.c.chord_unknown)]
        roots = [f"{r}:" for r in PITCH_CLASSES] if self.c.chord_tokens_with_root_note else [""]
        return [f"Chord_{r}{q}" for q in qualities for r in roots]

    @property
    def notes(self) -> list[str]:
        c, out = self.c, []
        if self.on_off:
            out += _numbered("NoteOn", self.pitches) + (_numbered("NoteOff", self.pitches) if c.uses_durations else [])
        else:
            out += _numbered("Pitch", self.pitches)
        out += self.velocities if c.use_velocities else []
        if (c.uses_durations and not self.on_off) or c.sustain_pedal_duration:
            out += self.durations
        return out

    @property
    def extras(self) -> list[str]:
        c = self.c
        reach = range(-c.max_pitch_interval, c.max_pitch_interval + 1)
        on, off = ("DrumOn", "DrumOff") if self.on_off else ("PitchDrum", None)
        pedal = c.programs if c.use_programs else (0,)
        return [
            *(_numbered("PitchIntervalTime", reach) + _numbered("PitchIntervalChord", reach) if c.use_pitch_intervals else []),
            *(_numbered(on, self.drums) + (_numbered(off, self.drums) if off else []) if c.use_pitchdrum_tokens else []),
            *(self.chords if c.use_chords else []),
            *(self.rests if c.use_rests else []),
            *(self.tempos if c.use_tempos else []),
            *(self.programs if c.use_programs else []),
            *(self.signatures if c.use_time_signatures else []),
            *([t for p in pedal for t in ([f"Pedal_{p}"] if c.sustain_pedal_duration else [f"Pedal_{p}", f"PedalOff_{p}"])] if c.use_sustain_pedals else []),
            *(_numbered("PitchBend", self.g.pitch_bends) if c.use_pitch_bends else []),
        ]


def _remi(x: Lists) -> list[str]:
    bars = x.c.additional_params.get("max_bar_embedding")
    head = _numbered("Bar", range(bars)) if bars else ["Bar_None"]
    return head + (["Bar_End"] if x.c.additional_params.get("use_bar_end_tokens") else []) + x.notes + x.positions + x.extras


def _pertok(x: Lists) -> list[str]:
    from .operators.pertok import PerTokGrid

    g = PerTokGrid.of(x.c)
    names = list(map(span_name, g.durations))
    # The notes' own durations are those of the tokenizer's finer grid.
    notes = [t for t in x.notes if not t.startswith("Duration_")]
    clock = _numbered("Position", g.positions) if g.use_positions else _numbered("TimeShift", names)
    lengths = _numbered("Duration", names) if any(p > 0 for p in x.c.use_note_duration_programs) else []
    micro = _numbered("MicroTiming", g.micro_ticks) if g.use_microtiming else []
    return list(dict.fromkeys(["Bar_None", *notes, *clock, *lengths, *micro, *x.extras]))


def _octuple(x: Lists) -> list[list[str]]:
    c = x.c
    pitch = _numbered("Pitch", x.pitches) + (_numbered("PitchDrum", x.drums) if c.use_pitchdrum_tokens else [])
    optional = [(c.use_velocities, x.velocities), (c.uses_durations, x.durations), (c.use_programs, x.programs), (c.use_tempos, x.tempos), (c.use_time_signatures, x.signatures)]
    return [pitch, x.positions, _numbered("Bar", range(c.additional_params["max_bar_embedding"])), *(v for on, v in optional if on)]


def _cpword(x: Lists) -> list[list[str]]:
    c = x.c
    pitch = _numbered("Pitch", x.pitches) + (_numbered("PitchDrum", x.drums) if c.use_pitchdrum_tokens else [])
    optional = [
        (c.use_velocities, x.velocities),
        (c.uses_durations, x.durations),
        (c.use_programs, x.programs),
        (c.use_chords, x.chords),
        (c.use_rests, x.rests),
        (c.use_tempos, x.tempos),
        (c.use_time_signatures, x.signatures),
    ]
    rest = [["Bar_None", *x.positions], pitch, *(v for on, v in optional if on)]
    return [["Family_Metric", "Family_Note"], *(["Ignore_None", *v] for v in rest)]


def _mumidi(x: Lists) -> list[list[str]]:
    c = x.c
    first = _numbered("Pitch", x.pitches) + _numbered("PitchDrum", x.drums) + ["Bar_None"] + x.positions + x.programs
    first += (x.chords if c.use_chords else []) + (x.rests if c.use_rests else [])
    bars = _numbered("BarPosEnc", range(c.additional_params["max_bar_embedding"]))
    places = ["PositionPosEnc_None", *_numbered("PositionPosEnc", range(x.g.positions))]
    optional = [(c.use_tempos, x.tempos), (c.use_velocities, x.velocities), (c.uses_durations, x.durations)]
    return [first, bars, places, *(v for on, v in optional if on)]


#: Tokenizer to the tokens after the special ones: a list, or one list for each part of a compound token.
BASE: dict[str, Callable[[Lists], list]] = {
    "REMI": _remi,
    "TSD": lambda x: x.notes + x.shifts + x.extras,
    "MIDILike": lambda x: list(dict.fromkeys(x.notes + x.shifts + x.extras)),
    "Structured": lambda x: x.notes + ["TimeShift_0.0.1"] + x.shifts + x.extras,
    "PerTok": _pertok,
    "Octuple": _octuple,
    "CPWord": _cpword,
    "MuMIDI": _mumidi,
}


def type_of(token: str) -> str:
    return token.split("_", 1)[0]


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with dense ids from 0, in one part or in several (compound tokens).

    ``letters`` are the characters that stand for the ids of the first part, where a file tells them.
    """

    parts: tuple[tuple[str, ...], ...]
    specials: tuple[str, ...]
    letters: tuple[str, ...] = ()

    @classmethod
    def of(cls, name: str, config: TokenizerConfig) -> Vocabulary:
        """``config`` must be :func:`adapted` to the tokenizer."""
        base = config.additional_params.get("base_tokenizer", "TSD") if name == "MMM" else name
        lists = BASE[base](Lists(config, base in NOTE_ON_OFF))
        parts = lists if base in COMPOUND else [lists]
        return cls(tuple(tuple(dict.fromkeys([*config.special_tokens, *p])) for p in parts), config.special_tokens)

    @classmethod
    def stored(cls, ids: dict[str, int], letters: dict[str, str], specials: tuple[str, ...]) -> Vocabulary:
        """Of a file's tokens with their ids, and characters with their tokens; ids must run from 0."""
        if sorted(ids.values()) != list(range(len(ids))):
            raise ValueError("the ids of the vocabulary are not those from 0 on")
        own = tuple(sorted(ids, key=ids.get))
        of = {token: letter for letter, token in letters.items()}
        if letters and set(own) - set(of):
            raise ValueError(f"tokens without a character: {sorted(set(own) - set(of))[:5]}")
        return cls((own,), tuple(t for t in specials if t in ids), tuple(of[t] for t in own) if letters else ())

    @property
    def is_compound(self) -> bool:
        return len(self.parts) > 1

    @property
    def sizes(self) -> list[int]:
        return [len(p) for p in self.parts]

    def __len__(self) -> int:
        return sum(self.sizes)

    @cached_property
    def ids(self) -> list[dict[str, int]]:
        return [{t: i for i, t in enumerate(p)} for p in self.parts]

    def id_of(self, token: str, part: int = 0) -> int:
        return self.ids[part][token]

    def token_of(self, number: int, part: int = 0) -> str:
        return self.parts[part][number]

    @property
    def pad_id(self) -> int:
        return self.id_of("PAD_None")

    @property
    def special_ids(self) -> list[int]:
        return [self.id_of(t) for t in self.specials]

    def ids_of_type(self, kind: str, part: int = 0) -> list[int]:
        return [i for i, t in enumerate(self.parts[part]) if type_of(t) == kind]

    def byte_of(self, number: int) -> str:
        return self.letters[number] if number < len(self.letters) else chr(number + FIRST_BYTE)

    def with_tokens(self, *tokens: str, special: bool = False, part: int = 0) -> Vocabulary:
        """A vocabulary with more tokens at the end of a part; known ones keep their id."""
        own = tuple(dict.fromkeys([*self.parts[part], *tokens]))
        specials = tuple(dict.fromkeys([*self.specials, *(tokens if special else ())]))
        return Vocabulary((*self.parts[:part], own, *self.parts[part + 1 :]), specials, self.letters)

    def table(self, spark: SparkSession) -> DataFrame:
        """vocab_idx, token, id, byte, type: a few hundred rows, for broadcast joins."""
        rows = [(p, t, i, self.byte_of(i), type_of(t)) for p, part in enumerate(self.parts) for i, t in enumerate(part)]
        return spark.createDataFrame(rows, "vocab_idx int, token string, id int, byte string, type string")
