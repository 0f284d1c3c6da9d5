"""Trained subword models over token ids, within bars, and back: byte pairs, unigrams, word pieces."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..vocabulary import Vocabulary
from .tokens import split_at_ticks


@dataclass(frozen=True)
class Marks:
    """What marks pieces and stands for no token of its own.

    ``prefix`` (of pieces inside a word), ``suffix`` (of pieces that end one), ``space`` (put before
    words), ``unknown`` (the piece that stands for what has none).
    """

    prefix: str = ""
    suffix: str = ""
    space: str = ""
    unknown: str | None = None

    @classmethod
    def of(cls, values: dict) -> Marks:
        """The marks of a tokenizers file, or of its ``model`` part."""
        model, before = values.get("model", values), values.get("pre_tokenizer") or {}
        space = before.get("replacement", "") if before.get("type") == "Metaspace" else ""
        return cls(model.get("continuing_subword_prefix") or "", model.get("end_of_word_suffix") or "", space, model.get("unk_token"))


class Model:
    """A trained model: ``vocabulary`` (piece to id), ``marks``, and ``encode`` from a text, taken as one word, to ids."""

    vocabulary: dict[str, int]
    marks: Marks

    def encode(self, text: str) -> list[int]:
        raise NotImplementedError

    def plain(self, piece: str) -> str:
        """A piece without its marks."""
        return piece.removeprefix(self.marks.prefix).removesuffix(self.marks.suffix).removeprefix(self.marks.space)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.vocabulary), default=0)


@dataclass(frozen=True)
class SubwordModel(Model):
    """A byte-pair model: its vocabulary and its merges in order of rank."""

    vocabulary: dict[str, int]
    merges: tuple[tuple[str, str], ...]
    marks: Marks = Marks()

    @classmethod
    def from_json(cls, text: str) -> SubwordModel:
        """A tokenizers file, or its ``model`` part (merges as pairs, or as strings with one blank)."""
        values = json.loads(text)
        model = values.get("model", values)
        pairs = tuple(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        return cls(dict(model["vocab"]), pairs, Marks.of(values))

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {pair: i for i, pair in enumerate(self.merges)}

    def encode(self, text: str) -> list[int]:
        """Ids of a text: the pair of the lowest rank is merged, the leftmost first, until none is left.

        Neighbours are linked and pairs wait in a heap, so a long text costs its length times a logarithm.
        """
        prefix = self.marks.prefix
        letters = self.marks.space + text if text else ""
        parts = [(prefix if i else "") + ch for i, ch in enumerate(letters)]
        if parts:
            parts[-1] += self.marks.suffix
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting = [(self.ranks[pair], i, *pair) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in self.ranks]
        heapq.heapify(waiting)
        while waiting:
            _, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != left or j == len(parts) or parts[j] != right:
                continue  # one of the two was merged with another since
            parts[i], parts[j] = left + right.removeprefix(prefix), None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (pair := (parts[k], parts[after[k]])) in self.ranks:
                    heapq.heappush(waiting, (self.ranks[pair], k, *pair))
        return [self.vocabulary[p] for p in parts if p is not None]


@dataclass(frozen=True)
class UnigramModel(Model):
    """Pieces with log-probabilities, in order of their ids; the likeliest way through the text counts."""

    pieces: tuple[tuple[str, float], ...]
    unknown_id: int | None = None
    marks: Marks = Marks()

    #: What a letter without a piece costs below the least likely piece.
    UNKNOWN_COST = 10.0

    @classmethod
    def from_json(cls, text: str) -> UnigramModel:
        values = json.loads(text)
        model = values.get("model", values)
        return cls(tuple((p, float(x)) for p, x in model["vocab"]), model.get("unk_id"), Marks.of(values))

    @cached_property
    def vocabulary(self) -> dict[str, int]:
        return {p: i for i, (p, _) in enumerate(self.pieces)}

    @cached_property
    def scores(self) -> dict[str, tuple[int, float]]:
        return {p: (i, x) for i, (p, x) in enumerate(self.pieces)}

    def encode(self, text: str) -> list[int]:
        """Ids of the best segmentation; of equal ones that whose last pieces start earlier.

        A letter that is no piece is unknown, and unknown neighbours are one.
        """
        letters = self.marks.space + text if text else ""
        unknown = min((x for _, x in self.pieces), default=0.0) - self.UNKNOWN_COST
        best: list[tuple[float, int, int] | None] = [(0.0, -1, -1), *[None] * len(letters)]
        for i in range(len(letters)):
            so_far, alone = best[i][0], False
            for j in range(i + 1, min(i + self.longest, len(letters)) + 1):
                if known := self.scores.get(letters[i:j]):
                    alone |= j == i + 1
                    if best[j] is None or so_far + known[1] > best[j][0]:
                        best[j] = (so_far + known[1], i, known[0])
            if not alone and (best[i + 1] is None or so_far + unknown > best[i + 1][0]):
                best[i + 1] = (so_far + unknown, i, -1)
        out, at = [], len(letters)
        while at:
            _, start, number = best[at]
            if number == -1 and self.unknown_id is None:
                raise ValueError(f"{letters[start:at]!r} is no piece of the model, and there is none for unknown ones")
            if number != -1 or not out or out[-1] != -1:
                out.append(number)
            at = start
        return [self.unknown_id if n == -1 else n for n in reversed(out)]


@dataclass(frozen=True)
class WordPieceModel(Model):
    """Pieces of which always the longest that fits is taken; a text that can't be taken apart is unknown as a whole."""

    vocabulary: dict[str, int]
    marks: Marks = Marks("##", unknown="[UNK]")
    most_letters: int = 100

    @classmethod
    def from_json(cls, text: str) -> WordPieceModel:
        values = json.loads(text)
        model = values.get("model", values)
        return cls(dict(model["vocab"]), Marks.of(values), int(model.get("max_input_chars_per_word", 100)))

    def _unknown(self) -> list[int]:
        if self.marks.unknown not in self.vocabulary:
            raise ValueError("the model has no piece for unknown texts")
        return [self.vocabulary[self.marks.unknown]]

    def encode(self, text: str) -> list[int]:
        letters, out, at = self.marks.space + text if text else "", [], 0
        if len(letters) > self.most_letters:
            return self._unknown()
        while at < len(letters):
            prefix = self.marks.prefix if at else ""
            for end in range(min(len(letters), at + self.longest), at, -1):
                if (number := self.vocabulary.get(prefix + letters[at:end])) is not None:
                    break
            else:
                return self._unknown()
            out.append(number)
            at = end
        return out


#: Model types of tokenizers files.
KINDS: dict[str, type] = {"BPE": SubwordModel, "Unigram": UnigramModel, "WordPiece": WordPieceModel}


def load_model(text: str) -> Model:
    """The model of a tokenizers file; one without a type has merges, or scores, or neither."""
    values = json.loads(text)
    model = values.get("model", values)
    kind = model.get("type") or ("BPE" if "merges" in model else "Unigram" if isinstance(model["vocab"], list) else "WordPiece")
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model {kind!r}; known: {', '.join(KINDS)}")
    return KINDS[kind].from_json(text)


def encode_ids(ids: DataFrame, vocabulary: Vocabulary, model: Model, ticks: DataFrame | None = None) -> DataFrame:
    """(score_id, seq_idx, pos, id) in the model's ids; with ``ticks`` merges don't cross them (bars or beats).

    ``ids`` has score_id, seq_idx, pos, id and, for a split, tick.  A split also cuts before every
    ``Track_Start``, as ticks begin anew with each track of a concatenated sequence.
    """
    table = vocabulary.table(ids.sparkSession).where("vocab_idx = 0").select("id", "byte")
    rows = ids.join(F.broadcast(table), "id")
    track = F.lit(0)
    if ticks is not None and "Track_Start" in vocabulary.ids[0]:
        w = Window.partitionBy("score_id", "seq_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        track = F.sum(F.when(F.col("id") == vocabulary.id_of("Track_Start"), 1).otherwise(0)).over(w).cast("int")
    rows = rows.withColumn("track", track)
    if ticks is None:
        rows = rows.withColumn("part", F.lit(0))
    else:
        rows = split_at_ticks(rows, ticks, "track")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "byte")))
    pieces = rows.groupBy("score_id", "seq_idx", "track", "part").agg(F.array_join(F.transform(ordered, lambda x: x.byte), "").alias("text"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["score_id", "seq_idx", "track", "part"]].assign(ids=[model.encode(t) for t in b["text"]])

    merged = pieces.mapInPandas(merge, "score_id long, seq_idx int, track int, part long, ids array<int>")
    n = F.size("ids")
    w = Window.partitionBy("score_id", "seq_idx").orderBy("track", "part")
    flat = merged.withColumn("first", F.sum(n).over(w) - n).select("score_id", "seq_idx", "first", F.posexplode("ids").alias("i", "id"))
    return flat.select("score_id", "seq_idx", (F.col("first") + F.col("i")).cast("long").alias("pos"), "id")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """(score_id, seq_idx, pos, id): the base ids that the model's ids stand for, pieces without their marks.

    Places follow from the lengths of the pieces before, so no sequence is gathered.  An id that the
    model lacks, or whose piece holds what the base vocabulary lacks, is an error.
    """
    base = {vocabulary.byte_of(i): i for i in range(vocabulary.sizes[0])}
    pieces = ((number, model.plain(piece)) for piece, number in model.vocabulary.items())
    rows = [(number, [base[ch] for ch in piece]) for number, piece in pieces if piece and all(ch in base for ch in piece)]
    # A mark alone stands for no token.
    rows += [(number, []) for piece, number in model.vocabulary.items() if not model.plain(piece)]
    table = encoded.sparkSession.createDataFrame(rows, "id int, base array<int>")  # the model's vocabulary
    unknown = F.raise_error(F.concat(F.lit("not a piece of the model: "), F.col("id").cast("string"))).cast("array<int>")
    long = encoded.join(F.broadcast(table), "id", "left").withColumn("base", F.coalesce("base", unknown))
    n = F.size("base")
    w = Window.partitionBy("score_id", "seq_idx").orderBy("pos")
    long = long.withColumn("first", F.sum(n).over(w) - n).select("score_id", "seq_idx", "first", F.posexplode("base").alias("i", "base_id"))
    return long.select("score_id", "seq_idx", (F.col("first") + F.col("i")).cast("long").alias("pos"), F.col("base_id").alias("id"))
