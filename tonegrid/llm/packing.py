"""Packing token sequences by minimum bin slack.

Documents are cut into full windows and a rest.  Only the number of rests of each length, 2,047
numbers at most, goes to the driver: a bitset subset-sum over them picks the multiset of lengths
that comes closest to a full window, its counts are read back from the bitset, and the pattern is used as
often as the numbers allow.  The plan says, for the k-th piece of each length, which sequence and
offset it gets; pieces are ranked per length in salted groups, so no length gathers in a task.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import blocks
from .storage import checkpointed

WINDOW, END_ID = 2048, 1
#: Groups, at least, into which the pieces of one length are dealt to be ranked; more of them where a
#: group would hold more than so many pieces.
SALTS, GROUP_PIECES = 1024, 50_000
#: Where texts hold only characters below this one and no run of blanks of this length, tiktoken may encode them.
PLAIN_BELOW, BLANK_RUN = 0x500, 500
# How byte-level tokenizers split a text before merges, and how they write bytes as characters.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


@functools.lru_cache(1)
def encoder_of(tokenizer_path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(tokenizer_path)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    others = [b for b in range(256) if b not in PRINTED]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids (little-endian 32-bit) of whole texts, as ``tokenizers`` gives them.

    A rank file of the same name beside the tokenizer is a faster way to the same ids (a quarter of
    the time).  It is used only where that is certain: its ranks were compared with the whole
    vocabulary and the split with that of the tokenizer, the text holds no special token's string,
    only characters below PLAIN_BELOW (whose letter and number classes all Unicode versions agree
    on) and no run of BLANK_RUN blanks, and encoding raised nothing.  All else goes to ``tokenizers``.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = os.path.splitext(tokenizer_path)[0] + ".tiktoken"
        self.ranks = self._same_as_ranks(ranks) if os.path.exists(ranks) else None

    def _same_as_ranks(self, path: str):
        """tiktoken with the ranks of ``path``, if they are this tokenizer's vocabulary; else None."""
        import tiktoken

        with open(path, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        parts = json.loads(self.tokenizer.to_str())
        split, alphabet = parts["pre_tokenizer"] or {}, byte_alphabet()
        plain = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        own = {k: v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items() if k not in self.special}
        if not plain or not all(c in alphabet for k in own for c in k) or {bytes(map(alphabet.get, k)): v for k, v in own.items()} != merges:
            return None
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=merges, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether the rank file is certain to give the tokenizer's ids."""
        if not text.isascii() and np.frombuffer(text.encode("utf-32-le"), "<u4").max() >= PLAIN_BELOW:
            return False
        return not any(x in text for x in self.special) and not (len(text) >= BLANK_RUN and LONG_BLANKS.search(text))

    def encode(self, text: str) -> bytes:
        if self.ranks is not None and self.plain(text):
            try:
                return array("I", self.ranks.encode_ordinary(text)).tobytes()
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # a panic of the library is no Exception
                pass
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


LONG_BLANKS = re.compile(rf"\s{{{BLANK_RUN}}}")


def token_pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: full windows of its ids (with the end id), then the rest.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` if asked for.  A null text
    counts as empty: its only id is the end id.  Repeated rows and null ids each give their own
    pieces; other columns of ``docs`` are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), *T._parse_datatype_string(PIECES + (", ids array<int>" if with_ids else "")).fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for part, texts in blocks(batches, "text"):
            row, columns = [], [[] for _ in schema.fields[1:]]
            for i, t in enumerate(texts):
                ids = encoder.encode(t or "") + end
                for a in range(0, len(ids), 4 * window):
                    piece = ids[a : a + 4 * window]
                    row.append(i)
                    values = (a // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, np.frombuffer(piece, "<u4").astype(np.int32) if with_ids else None)
                    for c, v in zip(columns, values, strict=False):
                        c.append(v)
            docs_of = part.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs_of, *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names=schema.names)

    return own.mapInArrow(run, schema)


def fill(counts: dict[int, int], largest: int, window: int = WINDOW) -> dict[int, int]:
    """Counts of the lengths that, with one ``largest``, come closest to a full window.

    Lengths are added from the largest to the smallest and their counts by powers of two; bit s of
    ``reach`` says that s tokens can be had, and the bitsets before each step give the counts back.
    """
    room, reach = window - largest, 1
    mask, steps = (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length] - (length == largest), room // length), 1
        while left > 0:
            n = min(size, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, size = left - n, size * 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used = {largest: 1}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + n
            best -= length * n
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first offset, first sequence) until all pieces are placed.

    The number of rows doesn't grow with the number of pieces: each pattern is used until one of
    its lengths no longer suffices.
    """
    left, taken, rows, sequence = {k: v for k, v in counts.items() if v > 0}, dict.fromkeys(counts, 0), [], 0
    while left:
        used = fill(left, max(left), window)
        times, offset = min(left[x] // n for x, n in used.items()), 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken[length], taken[length] + n * times, n, offset, sequence))
            offset += n * length
            taken[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (see :func:`token_pieces`) with ``sequence_id`` and ``offset`` (both long).

    Every piece gets a place; offsets in a sequence are gapless from 0 and no sequence is longer
    than ``window``.  Full pieces are sequences of their own, numbered after the planned ones as
    they lie (ids of sequences are unique, not gapless).  ``pieces`` must be checkpointed, as it is
    read more than once.  No pieces give no rows.
    """
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # `window` rows at most
    whole, rest = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)
    counts.pop(window, None)
    rows = sorted(plan(counts, window))
    planned = max((sequence + (end - first) // n for _, first, end, n, _, sequence in rows), default=0)
    alone = whole.withColumns({"sequence_id": F.monotonically_increasing_id() + planned, "offset": F.lit(0).cast("long")})
    sent = pieces.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 6))
    salts = max(SALTS, max(counts.values(), default=0) // GROUP_PIECES)
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(own).cast("long") - 1).join(groups, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))
    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            _, first, _, n, offset, sequence = table[at].T
            new = [sequence + (rank - first) // n, offset + (rank - first) % n * length]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in new)], names=[f.name for f in fields])

    return ranked.mapInArrow(place, T.StructType(fields)).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Cut, rank and place the pieces of all documents."""
    return pack(checkpointed(token_pieces(docs, tokenizer_path, doc_id, text, window, with_ids)), window)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence has ``window`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
