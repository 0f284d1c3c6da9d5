"""Standard MIDI files: a folder of files as score tables, and score tables as files.

Files are read by the data source ``midi``, each once, and its rows are stored by kind; every
table is one part of them.
"""

from __future__ import annotations

import struct
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scores import ScoreTables
from ..storage import stored

#: What a file's rows can be; one that can't be read has one row of kind ``error``.
KINDS = ("score", "note", "tempo", "signature", "pedal", "bend", "error")
ROW = "path string, kind string, track_idx int, seq long, program int, time long, duration long, a int, b int, x double, name string"


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and the place after it."""
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 127
        if byte < 128:
            return value, at


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        if at + 8 + size > len(data):
            raise ValueError("the file ends within a chunk")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size


def messages(track: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, data) of a track; meta messages have status 0xFF and their type as first byte."""
    at = tick = status = 0
    while at < len(track):
        delta, at = _number(track, at)
        tick += delta
        if track[at] >= 128:
            status, at = track[at], at + 1
        if status == 0xFF:
            kind = track[at : at + 1]
            size, at = _number(track, at + 1)
            yield tick, status, kind + track[at : at + size]
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _number(track, at)
            at += size
        else:
            size = 1 if status >> 4 in (0xC, 0xD) else 2
            yield tick, status, track[at : at + size]
            at += size


def parse(data: bytes, kinds: Iterable[str] = KINDS) -> list[tuple]:
    """Rows (kind, track_idx, seq, program, time, duration, a, b, x, name) of a file, of the given kinds alone.

    Tracks are told apart by track chunk, channel and program; channel 10 is drums (-1).  A note
    that is never released is dropped, one of no length too.
    """
    kinds = set(kinds)
    sounds = kinds & {"note", "pedal", "bend"}
    parts = list(chunks(data))
    if not parts or parts[0][0] != b"MThd":
        raise ValueError("not a standard MIDI file")
    _, _, division = struct.unpack(">HHH", parts[0][1][:6])
    if division & 0x8000:
        raise ValueError("SMPTE time is not supported")
    rows: list[tuple] = [("score", -1, 0, 0, 0, 0, division, 0, 0.0, None)] if "score" in kinds else []
    numbers: dict[tuple[int, int, int], int] = {}
    seq = 0
    for chunk, (kind, body) in enumerate(parts[1:]):
        if kind != b"MTrk":
            continue
        programs, held, pedals, name = defaultdict(int), defaultdict(deque), {}, None
        for tick, status, d in messages(body):
            seq += 1
            if status == 0xFF:
                meta, value = d[0], d[1:]
                if meta == 0x51 and "tempo" in kinds:
                    rows.append(("tempo", -1, seq, 0, tick, 0, 0, 0, float(int.from_bytes(value[:3], "big")), None))
                elif meta == 0x58 and "signature" in kinds:
                    rows.append(("signature", -1, seq, 0, tick, 0, value[0], 1 << value[1], 0.0, None))
                elif meta == 0x03:
                    name = value.decode("utf-8", "replace")
                continue
            if not sounds:
                continue
            channel, action = status & 15, status >> 4
            if action == 0xC:
                programs[channel] = d[0]
                continue
            program = -1 if channel == 9 else programs[channel]
            track = numbers.setdefault((chunk, channel, program), len(numbers))
            if action == 9 and d[1]:
                held[channel, d[0]].append((tick, d[1], track, program, seq))
            elif action in (8, 9):
                if held[channel, d[0]]:
                    start, velocity, own, prog, n = held[channel, d[0]].popleft()
                    if tick > start and "note" in kinds:
                        rows.append(("note", own, n, prog, start, tick - start, d[0], velocity, 0.0, name))
            elif action == 0xB and d[0] == 64:
                if d[1] >= 64:
                    pedals.setdefault(channel, tick)
                elif channel in pedals:
                    start = pedals.pop(channel)
                    if "pedal" in kinds:
                        rows.append(("pedal", track, seq, program, start, tick - start, 0, 0, 0.0, name))
            elif action == 0xE and "bend" in kinds:
                rows.append(("bend", track, seq, program, tick, 0, (d[0] | d[1] << 7) - 8192, 0, 0.0, name))
    return rows


def midi_rows(spark: SparkSession, path: str, kinds: Iterable[str] = KINDS) -> DataFrame:
    """Rows of all ``.mid`` and ``.midi`` files (any case) below ``path``, of the given kinds alone."""
    from .midi_source import MidiSource

    spark.dataSource.register(MidiSource)
    return spark.read.format("midi").option("kinds", ",".join(kinds)).load(path)


def read_midi(spark: SparkSession, path: str) -> ScoreTables:
    """All files below ``path`` as tables; ``score_id`` is a hash of the file's path.

    Every file is parsed once: the rows are stored by kind in the shared folder.  Files that can't be
    read are left out (:func:`bad_files` of the rows tells which).
    """
    return tables_of(stored(midi_rows(spark, path), "midi", "kind"))


def bad_files(rows: DataFrame) -> DataFrame:
    """(path, reason) of the files that could not be read."""
    return rows.where("kind = 'error'").select("path", F.col("name").alias("reason"))


def tables_of(parsed: DataFrame) -> ScoreTables:
    score = F.xxhash64("path").alias("score_id")
    of = lambda kind, *columns: parsed.where(F.col("kind") == kind).select(score, *columns)
    return ScoreTables(
        of("score", F.col("a").alias("tpq")),
        of("note", "track_idx", "program", "time", "duration", F.col("a").alias("pitch"), F.col("b").alias("velocity")),
        of("tempo", F.col("seq").cast("int").alias("seq"), "time", F.col("x").alias("mspq")),
        of("signature", F.col("seq").cast("int").alias("seq"), "time", F.col("a").alias("num"), F.col("b").alias("den")),
        of("pedal", "track_idx", "program", "time", "duration"),
        of("bend", "track_idx", "program", "time", F.col("a").alias("value")),
    )


def _length(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def _chunk(events: list[tuple[int, int, bytes]]) -> bytes:
    """A track of (tick, rank, message), ended."""
    body, last = b"", 0
    for tick, _, message in sorted(events):
        body += _length(tick - last) + message
        last = tick
    body += b"\x00\xff\x2f\x00"
    return b"MTrk" + struct.pack(">I", len(body)) + body


def compose(tpq: int, rows: list[tuple]) -> bytes:
    """A file from rows (kind, track_idx, program, time, duration, a, b, x).

    Pedals become pairs of control changes (64: 127, 0); without a tempo or signature at tick 0
    there are 120 quarters a minute and 4/4 from there.  Melodic tracks share channels if there are
    more than fifteen.
    """
    head: list[tuple[int, int, bytes]] = []
    tracks: dict[tuple[int, int], list] = defaultdict(list)
    for kind, track, program, time, duration, a, b, x in rows:
        if kind == "tempo":
            head.append((time, 1, b"\xff\x51\x03" + int(round(x)).to_bytes(3, "big")))
        elif kind == "signature":
            head.append((time, 0, b"\xff\x58\x04" + bytes([a, b.bit_length() - 1, 24, 8])))
        else:
            tracks[track, program].append((kind, time, duration, a, b))
    if not any(t == 0 and m[1] == 0x51 for t, _, m in head):
        head.append((0, 1, b"\xff\x51\x03" + (500000).to_bytes(3, "big")))
    if not any(t == 0 and m[1] == 0x58 for t, _, m in head):
        head.append((0, 0, b"\xff\x58\x04\x04\x02\x18\x08"))
    melodic = [c for c in range(16) if c != 9]
    out, n = [_chunk(head)], 0
    for (_, program), events in sorted(tracks.items()):
        channel = 9 if program == -1 else melodic[n % 15]
        n += program != -1
        own = [(0, 0, bytes([0xC0 | channel, max(program, 0)]))]
        for kind, time, duration, a, b in events:
            if kind == "note":
                own += [(time, 4, bytes([0x90 | channel, a, b])), (time + duration, 1, bytes([0x80 | channel, a, 0]))]
            elif kind == "pedal":
                own += [(time, 3, bytes([0xB0 | channel, 64, 127])), (time + duration, 2, bytes([0xB0 | channel, 64, 0]))]
            elif kind == "bend":
                value = a + 8192
                own.append((time, 3, bytes([0xE0 | channel, value & 127, value >> 7])))
        out.append(_chunk(own))
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(out), tpq) + b"".join(out)


def to_midi(tables: ScoreTables) -> DataFrame:
    """(score_id, content): the contents of one MIDI file per score."""
    null = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0)

    def rows(df: DataFrame | None, kind: str, track, program, duration, a, b, x) -> DataFrame | None:
        return df.select("score_id", F.lit(kind).alias("kind"), track.cast("int").alias("track_idx"), program.cast("int").alias("program"), F.col("time").cast("long").alias("time"), duration.cast("long").alias("duration"), a.cast("int").alias("a"), b.cast("int").alias("b"), x.cast("double").alias("x"))

    c = F.col
    parts = [
        rows(tables.notes, "note", c("track_idx"), c("program"), c("duration"), c("pitch"), c("velocity"), null("double")) if tables.notes is not None else None,
        rows(tables.tempos, "tempo", F.lit(-1), zero, zero, zero, zero, c("mspq")) if tables.tempos is not None else None,
        rows(tables.time_signatures, "signature", F.lit(-1), zero, zero, c("num"), c("den"), null("double")) if tables.time_signatures is not None else None,
        rows(tables.pedals, "pedal", c("track_idx"), c("program"), c("duration"), zero, zero, null("double")) if tables.pedals is not None else None,
        rows(tables.pitch_bends, "bend", c("track_idx"), c("program"), zero, c("value"), zero, null("double")) if tables.pitch_bends is not None else None,
    ]
    whole = None
    for p in (p for p in parts if p is not None):
        whole = p if whole is None else whole.unionByName(p)
    whole = whole.join(tables.scores.select("score_id", "tpq"), "score_id")
    columns = ["kind", "track_idx", "program", "time", "duration", "a", "b", "x"]

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(columns)
        found = [(k, int(t), int(p), int(s), int(d), int(a), int(b), x) for k, t, p, s, d, a, b, x in group[columns].itertuples(index=False)]
        return pd.DataFrame({"score_id": [key[0]], "content": [compose(int(group["tpq"].iloc[0]), found)]})

    return whole.groupBy("score_id").applyInPandas(write, "score_id long, content binary")


def write_midi(tables: ScoreTables, path: str, mode: str = "append") -> None:
    """One file ``<score_id>.mid`` per score in ``path``; mode ``overwrite`` first removes the MIDI files that are there."""
    from .midi_source import MidiSource

    tables.scores.sparkSession.dataSource.register(MidiSource)
    to_midi(tables).select(F.col("score_id").cast("string").alias("name"), "content").write.format("midi").mode(mode).save(path)
