"""A tokenizer as a lazy plan: preprocess, encode, decode and check score tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TokenizerConfig
from ..functions import lookup
from ..graph import Graph, type_graph
from ..grids import Grids
from ..operators import compound, decode, pertok, subword, timing, tokens, validate
from ..operators.controls import Control, available, requested
from ..operators.events import events, runs
from ..operators.pertok import PerTokGrid
from ..operators.scores import ScoreTables, bars, clip_to_bars, preprocess
from ..sources import midi
from ..vocabulary import COMPOUND, NAMES, Vocabulary, adapted


@dataclass(frozen=True)
class Scheme:
    """A tokenizer of one's own, as functions of a configuration and DataFrames.

    ``vocabulary`` lists the tokens after the special ones (lists of them for compound tokens); ``encode`` makes
    (score_id, seq_idx, pos, token or tokens, tick) of preprocessed tables, ``decode`` the tables again.
    ``adapt`` changes a configuration before all else; ``preprocess`` and ``errors`` (bad_type,
    bad_note, bad_time per token) stand in for the common ones.
    """

    vocabulary: Callable[[TokenizerConfig], list]
    encode: Callable[[ScoreTables, TokenizerConfig], DataFrame]
    decode: Callable[[DataFrame, TokenizerConfig], decode.Decoded]
    adapt: Callable[[TokenizerConfig], TokenizerConfig] = lambda c: c
    preprocess: Callable[[ScoreTables, TokenizerConfig], ScoreTables] = preprocess
    errors: Callable[[DataFrame, TokenizerConfig], DataFrame] | None = None
    graph: Callable[[TokenizerConfig], Graph] | None = None


SCHEMES: dict[str, Scheme] = {}


def register(name: str, scheme: Scheme) -> None:
    """Make ``Tokenizer.of(name)`` know a scheme.  Its functions and the tokens of a plain configuration are checked."""
    if name in NAMES or not name:
        raise ValueError(f"{name!r} is taken" if name else "a name is needed")
    functions = ("vocabulary", "encode", "decode", "adapt", "preprocess")
    if missing := [f for f in functions if not callable(getattr(scheme, f))]:
        raise TypeError(f"no functions: {', '.join(missing)}")
    lists = scheme.vocabulary(scheme.adapt(TokenizerConfig()))
    for part in lists if lists and isinstance(lists[0], list) else [lists]:
        if not part or any(not isinstance(t, str) or "_" not in t for t in part) or len(set(part)) < len(part):
            raise ValueError("tokens are different names of a type and a value, as Pitch_60")
    SCHEMES[name] = scheme


@dataclass(frozen=True)
class Tokenizer:
    """One of the nine tokenizers, or a registered one, with a configuration; immutable, cheap to make, driver-side only."""

    name: str
    config: TokenizerConfig
    vocabulary: Vocabulary = field(repr=False, default=None)
    controls: tuple[Control, ...] = field(repr=False, default=())
    model: subword.Model | None = field(repr=False, default=None)

    @classmethod
    def of(cls, name: str, config: TokenizerConfig | None = None) -> Tokenizer:
        if scheme := SCHEMES.get(name):
            c = scheme.adapt(config or TokenizerConfig())
            lists = scheme.vocabulary(c)
            parts = lists if isinstance(lists[0], list) else [lists]
            return cls(name, c, Vocabulary(tuple(tuple(dict.fromkeys([*c.special_tokens, *p])) for p in parts), c.special_tokens))
        if name not in NAMES:
            raise ValueError(f"unknown tokenizer {name!r}; known: {', '.join([*NAMES, *SCHEMES])}")
        c = adapted(name, config or TokenizerConfig())
        used = available(c)
        return cls(name, c, Vocabulary.of(name, c).with_tokens(*(t for control in used for t in control.names)), used)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        """A tokenizer file: its type under ``tokenization``, its configuration under ``config``.

        A trained one has its model under ``_model`` (a tokenizers file as text), its tokens with their ids under
        ``_vocab_base`` and the characters that stand for them under ``_vocab_base_byte_to_token``.
        """
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
        out = cls.of(values["tokenization"], TokenizerConfig.from_dict(values["config"]))
        if base := values.get("_vocab_base"):
            letters = values.get("_vocab_base_byte_to_token") or {}
            out = replace(out, vocabulary=Vocabulary.stored(base, letters, out.vocabulary.specials))
        return replace(out, model=subword.load_model(values["_model"])) if values.get("_model") else out

    def with_config(self, **changes) -> Tokenizer:
        return Tokenizer.of(self.name, self.config.with_(**changes))

    def with_tokens(self, *names: str, special: bool = False, part: int = 0) -> Tokenizer:
        return replace(self, vocabulary=self.vocabulary.with_tokens(*names, special=special, part=part))

    def with_control(self, control: Control) -> Tokenizer:
        """One more attribute control, for streams of one track; its tokens join the vocabulary."""
        if self.is_compound or self.config.one_token_stream_for_programs:
            raise ValueError("attribute controls stand in streams of one track only")
        return replace(self.with_tokens(*control.names), controls=(*self.controls, control))

    @property
    def base(self) -> str:
        """The tokenizer that lays out each stream."""
        return self.config.additional_params.get("base_tokenizer", "TSD") if self.name == "MMM" else self.name

    @property
    def note_on_off(self) -> bool:
        return self.base == "MIDILike"

    @property
    def is_compound(self) -> bool:
        return self.vocabulary.is_compound if self.name in SCHEMES else self.name in COMPOUND

    @property
    def is_trained(self) -> bool:
        return self.model is not None

    def encode_ids(self, ids: DataFrame, tables: ScoreTables | None = None) -> DataFrame:
        """Ids of the trained model, within bars or beats as ``encode_ids_split`` has it (which need the preprocessed tables)."""
        if self.model is None:
            raise ValueError("the tokenizer has no trained model")
        split = self.config.encode_ids_split
        ticks = None if split == "no" or tables is None else self.bars(tables, split)
        return subword.encode_ids(ids, self.vocabulary, self.model, ticks)

    def decode_ids(self, encoded: DataFrame) -> DataFrame:
        """The ids of the vocabulary that ids of the trained model stand for."""
        if self.model is None:
            raise ValueError("the tokenizer has no trained model")
        return subword.decode_ids(encoded, self.vocabulary, self.model)

    @property
    def one_stream(self) -> bool:
        return self.name == "MMM" or self.config.one_token_stream_for_programs

    @property
    def io_format(self) -> tuple[str, ...]:
        """Dimensions of an encoded score: instruments (if in streams of their own), time, classes (if compound)."""
        return (*(() if self.one_stream else ("I",)), "T", *(("C",) if self.is_compound else ()))

    @property
    def graph(self) -> Graph:
        if scheme := SCHEMES.get(self.name):
            if scheme.graph is None:
                raise ValueError(f"{self.name} has no type graph")
            return scheme.graph(self.config)
        return type_graph(self.name, self.config)

    @property
    def default_tempo(self) -> float:
        return Grids(self.config).default_tempo

    def preprocess(self, tables: ScoreTables) -> ScoreTables:
        if scheme := SCHEMES.get(self.name):
            return scheme.preprocess(tables, self.config)
        if self.name == "PerTok":
            return preprocess(tables, self.config, tpq=PerTokGrid.of(self.config).tpq, snap=False)
        return preprocess(tables, self.config, self.note_on_off)

    def encode(self, tables: ScoreTables, preprocessed: bool = False, request: DataFrame | None = None) -> DataFrame:
        """Tokens in long form, (score_id, seq_idx, pos, token, tick); compound ones with ``tokens``.

        ``request`` asks for attribute controls: (score_id, track_idx, control, bars), where
        ``control`` is a place in ``controls`` and null bars are all (see :mod:`..operators.controls`).
        """
        c = self.config
        t = tables if preprocessed else self.preprocess(tables)
        if scheme := SCHEMES.get(self.name):
            if request is not None:
                raise ValueError("attribute controls stand in streams of one track only")
            return scheme.encode(t, c)
        if self.name in ("Octuple", "MuMIDI"):
            t = clip_to_bars(t, c, c.additional_params["max_bar_embedding"])
        if request is not None and (self.is_compound or self.name == "PerTok" or c.one_token_stream_for_programs):
            raise ValueError("attribute controls stand in streams of one track only")
        if self.is_compound:
            return {"Octuple": compound.octuple, "CPWord": compound.cpword, "MuMIDI": compound.mumidi}[self.name](t, c)
        if self.name == "PerTok":
            return pertok.pertok(_with_tick_durations(t, c), c)
        made = None
        if request is not None:
            if not self.controls:
                raise ValueError("the configuration has no attribute controls")
            made = requested(t.notes, self.bars(t), request, self.controls, c)
        rows = (events if self.base == "Structured" else runs)(t, c, self.note_on_off, made)
        if self.base == "REMI" and made is not None:
            out = timing.remi(rows, t, c, controlled=True)
        else:
            out = {"REMI": timing.remi, "TSD": timing.tsd, "MIDILike": timing.midilike, "Structured": timing.structured}[self.base](rows, t, c)
        if c.program_changes and not c.one_token_stream_for_programs:
            own = rows.where("track >= 0").groupBy("score_id", "seq_idx").agg(F.first("program").alias("program"))
            out = timing.with_track_header(out, own, markers=self.name == "MMM")
        return timing.concatenated(out) if self.name == "MMM" else out

    def decode(self, sequence: DataFrame, programs: list[int] | None = None, sections: DataFrame | None = None) -> decode.Decoded:
        """Score tables of token sequences, or of ids (rows without ``token`` and ``tokens``).

        ``programs`` tells the program (-1: drums) of each stream in place of those in the tokens;
        streams beyond the list keep theirs.  ``sections`` of the preprocessed tables tell Octuple where bars
        without notes belong to the signature that follows, which its tokens don't.
        """
        if sections is not None and self.name != "Octuple":
            raise ValueError("only Octuple takes sections, the others tell every bar")
        if not {"token", "tokens"} & set(sequence.columns):
            sequence = self.tokens(sequence)
        out = self._decoded(sequence) if sections is None else decode.octuple(sequence, self.config, sections)
        if programs is None:
            return out
        told = F.coalesce(lookup(programs, F.col("seq_idx")), F.col("program"))
        own = {n: getattr(out, n).withColumn("program", told) for n in ("notes", "pedals", "pitch_bends")}
        return replace(out, **own)

    def save_midi(self, sequence: DataFrame, path: str, programs: list[int] | None = None, mode: str = "append") -> None:
        """Decode to files ``<score_id>.mid`` in ``path``; a stream's programs are tracks of it."""
        out = self.decode(sequence, programs)
        of = Grids(self.config).ticks_per_beat
        tpq = of.get(4, Grids(self.config).positions_per_beat)
        if self.name == "PerTok":
            tpq = PerTokGrid.of(self.config).tpq
        tracks = lambda df: df.withColumn("track_idx", F.col("seq_idx") * 256 + F.col("program") + 1).drop("seq_idx")
        scores = sequence.select("score_id").distinct().withColumn("tpq", F.lit(tpq))
        midi.write_midi(ScoreTables(scores, tracks(out.notes), out.tempos, out.time_signatures, tracks(out.pedals), tracks(out.pitch_bends)), path, mode)

    def _decoded(self, sequence: DataFrame) -> decode.Decoded:
        c = self.config
        if scheme := SCHEMES.get(self.name):
            return scheme.decode(sequence, c)
        if self.name == "MMM":
            streams = tokens.split_tracks(sequence, keep_markers=False)
            return getattr(decode, self.base.lower())(streams, c)
        return getattr(decode, self.name.lower())(sequence, c)

    def ids(self, sequence: DataFrame) -> DataFrame:
        return tokens.compound_to_ids(sequence, self.vocabulary) if self.is_compound else tokens.to_ids(sequence, self.vocabulary)

    def tokens(self, ids: DataFrame) -> DataFrame:
        return tokens.compound_to_tokens(ids, self.vocabulary) if self.is_compound else tokens.to_tokens(ids, self.vocabulary)

    def errors(self, sequence: DataFrame) -> DataFrame:
        """Per token: bad_type, bad_note, bad_time."""
        c = self.config
        if scheme := SCHEMES.get(self.name):
            if scheme.errors is None:
                return validate.token_errors(sequence, self.graph, c)
            return scheme.errors(sequence, c)
        if self.name == "Octuple":
            return validate.octuple_errors(sequence, c)
        if self.name == "PerTok":
            return sequence.select("score_id", "seq_idx", "pos", *(F.lit(False).alias(n) for n in ("bad_type", "bad_note", "bad_time")))
        if self.name == "CPWord":
            return validate.cpword_errors(sequence, self.graph, c)
        if self.name == "MuMIDI":
            return validate.mumidi_errors(sequence, self.graph, c)
        if self.name == "MMM":
            sequence = tokens.split_tracks(sequence, keep_markers=False)
        return (validate.note_off_errors if self.note_on_off else validate.token_errors)(sequence, self.graph, c)

    def error_counts(self, sequence: DataFrame) -> DataFrame:
        """(score_id, seq_idx, n_tokens, n_errors): :meth:`errors` counted by stream."""
        if self.name in SCHEMES or self.is_compound or self.name == "PerTok":
            return validate.error_counts(self.errors(sequence))
        if self.name == "MMM":
            sequence = tokens.split_tracks(sequence, keep_markers=False)
        return (validate.note_off_error_counts if self.note_on_off else validate.token_error_counts)(sequence, self.graph, self.config)

    def error_ratio(self, sequence: DataFrame) -> DataFrame:
        return validate.with_ratio(self.error_counts(sequence))

    def bars(self, tables: ScoreTables, unit: str = "bar") -> DataFrame:
        return bars(tables, self.config, unit)


def _with_tick_durations(t: ScoreTables, c: TokenizerConfig) -> DataFrame:
    """Events whose durations are ticks, for a tokenizer with a grid of its own."""
    rows = events(t, c.with_(use_note_duration_programs=()))
    if not c.uses_durations:
        return rows
    # A duration follows the last event of its note.
    ends = rows.where(F.col("type").isin("Pitch", "PitchDrum", "PitchIntervalTime", "PitchIntervalChord")).withColumn("value", (F.col("note_end") - F.col("time")).cast("string"))
    lengths = ends.withColumns({"type": F.lit("Duration"), "sub": F.lit(9), "note_end": F.lit(None).cast("long")})
    return rows.unionByName(lengths)
