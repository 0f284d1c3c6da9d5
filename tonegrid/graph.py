"""Which token type may follow which, from the flags of a configuration."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .config import TokenizerConfig
from .vocabulary import type_of

Graph = dict[str, set[str]]


class _Edges:
    """Edges that are added only if both ends can occur."""

    def __init__(self, present: set[str]) -> None:
        self.present, self.graph = present, defaultdict(set)

    def add(self, sources: str | Iterable[str], targets: str | Iterable[str]) -> None:
        as_set = lambda x: {x} if isinstance(x, str) else set(x)
        for s in as_set(sources) & self.present:
            self.graph[s] |= as_set(targets) & self.present


def timed_graph(name: str, c: TokenizerConfig) -> Graph:
    """REMI, TSD and MIDILike: notes hang from a clock (positions in bars, or time shifts)."""
    on_off, bars = name == "MIDILike", name == "REMI"
    note = "NoteOn" if on_off else "Pitch"
    inline = c.use_programs and not c.program_changes
    first = "Program" if inline else note
    clock = "Position" if bars else "TimeShift"
    moves = {"Position", "Bar"} if bars else {"TimeShift"}
    lengths = c.uses_durations and not on_off
    last = "Duration" if lengths else "Velocity" if c.use_velocities else note
    intervals = {"PitchIntervalTime", "PitchIntervalChord"} if c.use_pitch_intervals else set()
    flags = [
        (True, {note, *moves}),
        (c.use_programs, {"Program"}),
        (c.use_velocities, {"Velocity"}),
        (lengths or c.sustain_pedal_duration, {"Duration"}),
        (on_off and c.uses_durations, {"NoteOff"}),
        (True, intervals),
        (c.use_chords, {"Chord"}),
        (c.use_rests, {"Rest"}),
        (c.use_tempos, {"Tempo"}),
        (c.use_time_signatures, {"TimeSig"}),
        (c.use_sustain_pedals, {"Pedal"}),
        (c.use_sustain_pedals and not c.sustain_pedal_duration, {"PedalOff"}),
        (c.use_pitch_bends, {"PitchBend"}),
    ]
    e = _Edges(set().union(*(s for on, s in flags if on)))

    # A note: program, pitch or interval, velocity, duration; then another note or the clock.
    e.add("Program", {note, "NoteOff"} if inline or on_off else {note})
    chain = [x for x, on in ((note, True), ("Velocity", c.use_velocities), ("Duration", lengths)) if on]
    for a, b in zip(chain, chain[1:], strict=False):
        e.add({a} | (intervals if a == note else set()), b)
    e.add(last, {first} | moves)
    if last == note:
        e.add(intervals, {first} | intervals | moves)
    e.add(clock, first)
    e.add("TimeShift", "TimeShift")
    e.add("NoteOff", {"NoteOff", first, "TimeShift"})
    e.add("TimeShift", "NoteOff" if not inline else set())
    e.add("Program" if inline else {last, clock, "NoteOff"}, intervals)
    if bars:
        e.add("Bar", {"TimeSig"} if c.use_time_signatures else moves)
        if c.use_time_signatures and c.additional_params.get("use_bar_end_tokens"):
            e.add("Bar", "Bar")

    # Events that open a tick: each may follow the clock and is followed by what can come after it there.
    opened = {first} | moves | intervals
    e.add(clock, {"Chord", "Tempo", "Pedal", "PedalOff"} | (set() if bars else {"TimeSig"}))
    e.add("Tempo", opened | {"Chord", "Rest", "Pedal", "PedalOff"} | ({"TimeSig"} if bars else set()))
    e.add("TimeSig", opened | {"Chord", "Rest", "Pedal", "PedalOff"} | (set() if bars else {"Tempo"}))
    e.add("Chord", {first, "PedalOff"} | intervals)
    if c.use_programs:
        e.add("Program", "Chord")
    if c.sustain_pedal_duration:
        e.add("Pedal", {"Duration"})
        e.add(last, "Pedal")
        e.add("Duration", {first, *moves, "Pedal", "Rest", "Chord"} | intervals)
    else:
        e.add({"Pedal", "PedalOff"}, opened | {"Pedal", "Chord", "Rest"})
        e.add("PedalOff", "PedalOff")
    e.add("PitchBend", {first, *moves, "Chord", "Rest"})
    e.add({"Program"} if inline else {clock, "Tempo", "TimeSig", "Pedal", "PedalOff"} | ({"Duration"} if c.sustain_pedal_duration else set()), "PitchBend")
    e.add("Rest", {"Rest", first, *moves, "Chord", "Tempo", "TimeSig", "Pedal", "PedalOff", "PitchBend"} | intervals)
    e.add({last, "NoteOff"}, "Rest")
    if c.program_changes:
        e.add(last, "Program")
        if bars and c.additional_params.get("use_bar_end_tokens"):
            e.add("Program", "Bar")
        around = {clock, "Rest", "PitchBend", "Pedal", "PedalOff", "Tempo", "TimeSig", "Chord", "NoteOff"}
        e.add("Program", around)
        e.add(around, "Program")
    return e.graph


def with_drums(graph: Graph, pairs: Iterable[tuple[str, str]]) -> Graph:
    """Drum types stand wherever the melodic type does."""
    for melodic, drum in pairs:
        if melodic in graph:
            graph[drum] = set(graph[melodic])
            for targets in graph.values():
                if melodic in targets:
                    targets.add(drum)
    return graph


def structured_graph(c: TokenizerConfig) -> Graph:
    opening = {"Program"} if c.use_programs else {"Pitch"}
    e = _Edges({"TimeShift", "Pitch", "Program", "Velocity", "Duration"})
    chain = ["Pitch", *(["Velocity"] if c.use_velocities else []), *(["Duration"] if c.uses_durations else []), "TimeShift"]
    for a, b in zip(chain, chain[1:], strict=False):
        e.add(a, b)
    e.add("TimeShift", opening)
    if c.use_programs:
        e.add("Program", "Pitch")
    return e.graph


def cpword_graph(c: TokenizerConfig) -> Graph:
    e = _Edges({"Bar", "Position", "Pitch"} | ({"Rest"} if c.use_rests else set()) | ({"Tempo"} if c.use_tempos else set()) | ({"TimeSig"} if c.use_time_signatures else set()))
    e.add("Bar", {"Position", "Bar", "Rest"})
    e.add("Position", {"Pitch", "Bar", "Position", "Rest"} if c.use_tempos or c.use_chords else "Pitch")
    e.add("Pitch", {"Pitch", "Bar", "Position", "Rest"})
    e.add("Rest", {"Rest", "Position", "Bar"})
    graph = e.graph
    kinds = set(graph)
    for targets in graph.values():
        targets.add("Ignore")
    graph["Ignore"] = kinds
    return graph


def mumidi_graph(c: TokenizerConfig) -> Graph:
    e = _Edges({"Bar", "Position", "Program", "Pitch", "PitchDrum"} | ({"Chord"} if c.use_chords else set()))
    e.add("Bar", {"Bar", "Position"})
    e.add("Position", "Program")
    e.add("Program", {"Pitch", "PitchDrum", "Chord"})
    e.add({"Pitch", "PitchDrum"}, {"Program", "Bar", "Position"})
    e.add("Pitch", "Pitch")
    e.add("PitchDrum", "PitchDrum")
    e.add("Chord", {"Pitch", "Chord"})
    return e.graph


def type_graph(name: str, c: TokenizerConfig) -> Graph:
    """Token type to the types that may follow it; specials may stand anywhere but before BOS and after EOS."""
    base = c.additional_params.get("base_tokenizer", "TSD") if name == "MMM" else name
    if base in ("REMI", "TSD", "MIDILike"):
        graph = timed_graph(base, c)
        pairs = [("NoteOn", "DrumOn"), ("NoteOff", "DrumOff")] if base == "MIDILike" else [("Pitch", "PitchDrum")]
    elif base == "Structured":
        graph, pairs = structured_graph(c), [("Pitch", "PitchDrum")]
    elif base == "CPWord":
        graph, pairs = cpword_graph(c), [("Pitch", "PitchDrum")]
    elif base == "MuMIDI":
        return _with_specials(mumidi_graph(c), c)
    else:
        return {}
    if c.use_pitchdrum_tokens:
        graph = with_drums(graph, pairs)
    return _with_specials(graph, c)


def _with_specials(graph: Graph, c: TokenizerConfig) -> Graph:
    kinds = set(graph)
    specials = set(map(type_of, c.special_tokens))
    for s in specials:
        graph[s] = set() if s == "EOS" else kinds | specials
        if s != "BOS":
            for k in kinds:
                graph[k].add(s)
    return dict(graph)


def edges(spark: SparkSession, graph: Graph) -> DataFrame:
    """(from_type, to_type): a few hundred rows."""
    rows = sorted((a, b) for a, targets in graph.items() for b in targets)
    return spark.createDataFrame(rows, "from_type string, to_type string")
