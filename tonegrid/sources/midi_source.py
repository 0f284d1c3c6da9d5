"""The data source ``midi``: folders of standard MIDI files as rows, and rows as files.

Reading is planned by file size: the driver lists the files, tasks open and parse them.  Writing is
staged: a task writes into a folder of its own below the target, and only the files of tasks that
Spark has accepted are moved to their place.  Paths are local or shared ones, or URIs that
``pyarrow.fs`` knows.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .midi import KINDS, ROW, parse

#: A task reads files of about so many bytes, and yields batches of about so many rows.
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 50_000
COLUMNS = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("track_idx", pa.int32()), ("seq", pa.int64()), ("program", pa.int32()), ("time", pa.int64()),
    ("duration", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("x", pa.float64()), ("name", pa.string()),
])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    path = re.sub(r"^file:/+", "file:///", path)
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:", path) else (pafs.LocalFileSystem(), path)


def is_midi(path: str) -> bool:
    return path.lower().endswith((".mid", ".midi"))


@dataclass
class Files(InputPartition):
    paths: list[str]


def planned(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in the order of their paths, cut into parts of about ``most`` bytes; a file is never cut."""
    out, size = [], 0
    for path, n in sorted(files):
        if not out or size and size + n > most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(path)
        size += n
    return out


class MidiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.kinds = frozenset(k.strip() for k in options.get("kinds", ",".join(KINDS)).split(","))
        self.most = int(options.get("bytesperpartition", options.get("bytesPerPartition", PARTITION_BYTES)))
        if unknown := self.kinds - set(KINDS):
            raise ValueError(f"unknown kinds {sorted(unknown)}; known: {', '.join(KINDS)}")

    def partitions(self) -> list[Files]:
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = [(i.path, i.size) for i in found if i.is_file and is_midi(i.path) and "/.staging-" not in i.path]
        return planned(files, self.most) or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows: list[tuple] = []
        for path in part.paths:
            with fs.open_input_stream(path) as f:
                rows += rows_of(path, f.read(), self.kinds)
            if len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def rows_of(path: str, data: bytes, kinds: frozenset[str]) -> list[tuple]:
    """The rows of a file; one of kind ``error`` alone, with the reason as name, if it can't be read."""
    try:
        return [(path, *r) for r in parse(data, kinds)]
    except (ValueError, IndexError, struct.error) as e:
        return [(path, "error", -1, 0, 0, 0, 0, 0, 0, 0.0, f"{type(e).__name__}: {e}")] if "error" in kinds else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COLUMNS.types, strict=True)], schema=COLUMNS)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class MidiWriter(DataSourceArrowWriter):
    """Rows (name, content) as files ``<name>.mid``."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        if {"name", "content"} - set(columns):
            raise ValueError("columns name and content are needed")
        self.path, self.overwrite, self.staging = path.rstrip("/"), overwrite, f"{path.rstrip('/')}/.staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.staging)
        folder, names = f"{root}/{uuid.uuid4().hex}", []  # of this attempt alone
        fs.create_dir(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or "/" in name:
                    raise ValueError(f"{name!r} can't be a file's name")
                with fs.open_output_stream(f"{folder}/{name}.mid") as f:
                    f.write(content or b"")
                names.append(f"{name}.mid")
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name; nothing was written")
        fs.create_dir(root)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(root)):
                if i.is_file and is_midi(i.path):
                    fs.delete_file(i.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: fs.move(*x), [(f"{m.folder}/{n}", f"{root}/{n}") for m in done for n in m.names]))
        fs.delete_dir(filesystem(self.staging)[1])

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.staging)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


class MidiSource(DataSource):
    """``spark.read.format("midi").option("kinds", "note,tempo").load(folder)`` and ``df.write.format("midi").save(folder)``.

    Options: ``kinds`` (of the rows wanted, all of KINDS by default; the rest isn't made), ``bytesPerPartition``.
    """

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> MidiReader:
        return MidiReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MidiWriter:
        return MidiWriter(self.options["path"], schema.names, overwrite)
