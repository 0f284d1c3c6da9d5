"""Tokenizer configuration: what is tokenized, on which grids, with which special tokens."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Defaults that decide vocabularies and ids.
BEAT_RES = {(0, 4): 8, (4, 12): 4}
BEAT_RES_REST = {(0, 1): 8, (1, 2): 4, (2, 12): 2}
SPECIAL_TOKENS = ("PAD", "BOS", "EOS", "MASK")
TIME_SIGNATURES = ((8, (3, 12, 6)), (4, (5, 6, 3, 2, 1, 4)))
CHORD_MAPS = (
    ("min", (0, 3, 7)),
    ("maj", (0, 4, 7)),
    ("dim", (0, 3, 6)),
    ("aug", (0, 4, 8)),
    ("sus2", (0, 2, 7)),
    ("sus4", (0, 5, 7)),
    ("7dom", (0, 4, 7, 10)),
    ("7min", (0, 3, 7, 10)),
    ("7maj", (0, 4, 7, 11)),
    ("7halfdim", (0, 3, 6, 10)),
    ("7dim", (0, 3, 6, 9)),
    ("7aug", (0, 4, 8, 11)),
    ("9maj", (0, 4, 7, 10, 14)),
    ("9min", (0, 4, 7, 10, 13)),
)
PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
ALL_PROGRAMS = tuple(range(-1, 128))
DEFAULT_TEMPO = 120.0
DEFAULT_VELOCITY = 100


def special_token(name: str) -> str:
    """The name with exactly one underscore: ``X`` becomes ``X_None``, ``a_b_c`` becomes ``a-b_c``."""
    head, _, tail = name.rpartition("_")
    return f"{head.replace('_', '-')}_{tail}" if head else f"{tail}_None"


def _ranges(value: dict) -> dict[tuple[int, int], int]:
    return {(k if isinstance(k, tuple) else tuple(map(int, k.split("_")))): v for k, v in value.items()}


@dataclass(frozen=True)
class TokenizerConfig:
    """All settings; immutable.  Contradictory flags are resolved when the object is made."""

    pitch_range: tuple[int, int] = (21, 109)
    beat_res: dict = field(default_factory=lambda: dict(BEAT_RES))
    num_velocities: int = 32
    remove_duplicated_notes: bool = False
    encode_ids_split: str = "bar"
    special_tokens: tuple[str, ...] = SPECIAL_TOKENS
    use_velocities: bool = True
    use_note_duration_programs: tuple[int, ...] = ALL_PROGRAMS
    use_chords: bool = False
    use_rests: bool = False
    use_tempos: bool = False
    use_time_signatures: bool = False
    use_sustain_pedals: bool = False
    use_pitch_bends: bool = False
    use_programs: bool = False
    use_pitch_intervals: bool = False
    use_pitchdrum_tokens: bool = True
    default_note_duration: float = 0.5
    beat_res_rest: dict = field(default_factory=lambda: dict(BEAT_RES_REST))
    chord_maps: tuple = CHORD_MAPS
    chord_tokens_with_root_note: bool = False
    chord_unknown: tuple[int, ...] = ()
    num_tempos: int = 32
    tempo_range: tuple[int, int] = (40, 250)
    log_tempos: bool = False
    delete_equal_successive_tempo_changes: bool = False
    time_signature_range: tuple = TIME_SIGNATURES
    delete_equal_successive_time_sig_changes: bool = False
    sustain_pedal_duration: bool = False
    pitch_bend_range: tuple[int, int, int] = (-8192, 8191, 32)
    programs: tuple[int, ...] = ALL_PROGRAMS
    one_token_stream_for_programs: bool = True
    program_changes: bool = False
    max_pitch_interval: int = 16
    pitch_intervals_max_time_dist: int = 1
    drums_pitch_range: tuple[int, int] = (27, 88)
    ac_polyphony_track: bool = False
    ac_polyphony_bar: bool = False
    ac_polyphony_min: int = 1
    ac_polyphony_max: int = 6
    ac_pitch_class_bar: bool = False
    ac_note_density_track: bool = False
    ac_note_density_track_min: int = 0
    ac_note_density_track_max: int = 18
    ac_note_density_bar: bool = False
    ac_note_density_bar_max: int = 18
    ac_note_duration_bar: bool = False
    ac_note_duration_track: bool = False
    ac_repetition_track: bool = False
    ac_repetition_track_num_bins: int = 10
    ac_repetition_track_num_consec_bars: int = 4
    additional_params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        for name in ("pitch_range", "use_note_duration_programs", "programs", "tempo_range", "pitch_bend_range", "drums_pitch_range"):
            put(name, tuple(getattr(self, name)))
        put("programs", tuple(dict.fromkeys(self.programs)))
        put("use_note_duration_programs", tuple(dict.fromkeys(self.use_note_duration_programs)))
        put("chord_unknown", tuple(self.chord_unknown or ()))
        put("beat_res", _ranges(self.beat_res))
        put("beat_res_rest", _ranges(self.beat_res_rest))
        items = lambda x: x.items() if isinstance(x, dict) else x
        put("time_signature_range", tuple((int(d), tuple(n)) for d, n in items(self.time_signature_range)))
        put("chord_maps", tuple((k, tuple(v)) for k, v in items(self.chord_maps)))
        names = dict.fromkeys(map(special_token, self.special_tokens))
        put("special_tokens", tuple(dict.fromkeys([*names, special_token("PAD")])))
        put("one_token_stream_for_programs", self.one_token_stream_for_programs and self.use_programs)
        put("program_changes", self.program_changes and self.use_programs)
        put("sustain_pedal_duration", self.sustain_pedal_duration and self.use_sustain_pedals)
        lo, hi = self.pitch_range
        if not 0 <= lo < hi <= 127:
            raise ValueError(f"pitch_range must lie within 0 and 127 and rise: {self.pitch_range}")
        if not 1 <= self.num_velocities <= 127:
            raise ValueError(f"num_velocities must lie within 1 and 127: {self.num_velocities}")
        if not 0 <= self.max_pitch_interval <= 127:
            raise ValueError(f"max_pitch_interval must lie within 0 and 127: {self.max_pitch_interval}")
        if self.use_time_signatures and any(d < 1 or d & (d - 1) for d, _ in self.time_signature_range):
            raise ValueError("denominators of time signatures must be powers of two")
        everywhere = set(self.programs if self.use_programs else ALL_PROGRAMS) <= set(self.use_note_duration_programs)
        put("use_rests", self.use_rests and everywhere)  # rests need the ends of all notes
        if self.use_rests and max(self.beat_res_rest.values()) > self.max_positions_per_beat:
            raise ValueError("rests can't be finer than the beat resolution")

    @property
    def max_positions_per_beat(self) -> int:
        return max(self.beat_res.values())

    @property
    def uses_durations(self) -> bool:
        return bool(self.use_note_duration_programs)

    def with_(self, **changes: Any) -> TokenizerConfig:
        return replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        keyed = lambda d: {f"{a}_{b}": v for (a, b), v in d.items()}
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        out |= {"beat_res": keyed(self.beat_res), "beat_res_rest": keyed(self.beat_res_rest)}
        out |= {"time_signature_range": {str(d): list(n) for d, n in self.time_signature_range}, "chord_maps": {k: list(v) for k, v in self.chord_maps}}
        out["chord_unknown"] = list(self.chord_unknown) or None
        return {k: list(v) if isinstance(v, tuple) else v for k, v in out.items()}

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> TokenizerConfig:
        """Known keys of ``values``; missing and null ones take their default."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})

    @classmethod
    def load(cls, path: str) -> TokenizerConfig:
        """A configuration file, or a tokenizer file that holds one under ``config``."""
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
        return cls.from_dict(values.get("config", values))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=4)
