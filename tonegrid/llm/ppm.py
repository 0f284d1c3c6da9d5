"""Language-model scores: prediction by partial matching over bytes, and a word model as a base.

The trie holds all contexts of up to ORDER bytes and what follows them, counted over all training
texts.  It has no bound, so it never meets in one place: contexts are dealt into groups by the last SPLIT of their symbols,
which a context shares with its suffixes down to that length.  A task builds a group and writes it to the shared folder, and tasks that
score map the groups into memory.  (With a ``least_share`` above zero, a smaller model: only continuations that make up so
much of all training symbols are nodes, and what a context loses thereby counts towards its
escape.)  The chance of a symbol comes from the longest known context that has it: every longer one
contributes its escape, (lost + distinct) / (total + distinct), and its symbols are excluded
below.  In a trie of fixed counts the symbols of a context are a subset of those of its suffix, so
that what exclusion takes away is a number per context, and whole blocks of text are scored at once.

Words have no bound.  Frequent ones, of which there are 1 / FREQUENT_SHARE at most, travel to
every task; the others meet their counts in a join, in which no word can be hot.
"""

from __future__ import annotations

import dataclasses
import math
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import append_columns, blocks, without
from .storage import checkpointed, shared_place

#: Bytes of context, at most 6: a context and its symbol are packed into a long, 9 bits each.
ORDER = 5
BITS, END, START = 9, 256, 257
#: Symbols that can follow: all bytes and the end of the text.
SYMBOLS = 257
#: All contexts are kept.
LEAST_SHARE, FREQUENT_SHARE = 0.0, 2.0**-19
#: Contexts of a group end in the same symbols, so many of them; shorter ones are few (257 * 258 continuations) and go everywhere.
SPLIT = 2
#: Continuations of the longest contexts in a group, about; the groups are as many as they need.
GROUP_GRAMS = 1 << 18
#: Added to the counts of words.
ADDED = 0.1
#: The token at the end of a text; no word holds a blank.
END_TOKEN = "\n"
#: A task sends its counts on when it has so many of words or of contexts.
MOST_COUNTS = 1 << 18
MOST_GRAMS = 1 << 20
#: Symbols that are worked on at once.
PIECE = 1 << 19


def _mask(symbols: int) -> int:
    return (1 << (BITS * symbols)) - 1


def pieces(texts: list[str | None], order: int = ORDER, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about ``most`` symbols of the texts, however long a text is: (keys, starts, numbers).

    ``keys`` has each symbol packed with the ``order`` symbols before it; part i of a run starts at
    ``starts[i]`` among them and belongs to text ``numbers[i]``.
    """
    parts: list[np.ndarray] = []
    numbers: list[int] = []
    held = 0
    for number, text in enumerate(texts):
        raw = text.encode() if text else b""
        for at in range(0, len(raw) + 1, most):
            end = min(at + most, len(raw) + 1)
            symbols = np.full(order + end - at, START, np.int64)
            before = raw[max(0, at - order) : at]
            symbols[order - len(before) : order] = np.frombuffer(before, np.uint8)
            own = raw[at:end]
            symbols[order : order + len(own)] = np.frombuffer(own, np.uint8)
            if end > len(raw):
                symbols[-1] = END
            parts.append(symbols)
            numbers.append(number)
            held += end - at
            if held >= most:
                yield _packed(parts, order), *_starts(parts, numbers, order)
                parts, numbers, held = [], [], 0
    if parts:
        yield _packed(parts, order), *_starts(parts, numbers, order)


def _starts(parts: list[np.ndarray], numbers: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) - order
    return np.cumsum(lengths) - lengths, np.array(numbers)


def _packed(parts: list[np.ndarray], order: int) -> np.ndarray:
    symbols = np.concatenate(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    own = np.ones(len(symbols), bool)
    own[((np.cumsum(lengths) - lengths)[:, None] + np.arange(order)).ravel()] = False
    keys = symbols.copy()
    for j in range(1, order + 1):
        keys[j:] |= symbols[:-j] << (BITS * j)
    return keys[own]


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(word or gram, in training texts, in all texts) as a task has counted them."""
    trained, held, grams, numbers = Counter(), Counter(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    schema = pa.schema([("word", pa.string()), ("gram", pa.int64()), ("trained", pa.int64()), ("total", pa.int64())])

    def sent() -> pa.RecordBatch:
        keys = list(trained | held)
        t = np.fromiter((trained[w] for w in keys), np.int64, len(keys))
        all_ = t + np.fromiter((held[w] for w in keys), np.int64, len(keys))
        names = pa.concat_arrays([pa.array([w.decode() for w in keys], pa.string()), pa.nulls(len(grams), pa.string())])
        own = pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(grams)])
        return pa.RecordBatch.from_arrays([names, own, pa.array(np.append(t, numbers)), pa.array(np.append(all_, numbers))], schema=schema)

    for part, texts in (x for batch in batches for x in blocks([batch], "text")):
        train = part.column(part.schema.get_field_index("train")).to_pylist()
        for t, own in zip(texts, train, strict=True):
            into = trained if own else held
            into.update(words(t))
            into[END_TOKEN.encode()] += 1
        for keys, _, _ in pieces([t for t, own in zip(texts, train, strict=True) if own], order):
            keys, n = np.unique(keys, return_counts=True)
            grams, numbers = _added(grams, numbers, keys, n)
        if len(grams) > MOST_GRAMS or max(len(trained), len(held)) > MOST_COUNTS:
            yield sent()
            trained, held, grams, numbers = Counter(), Counter(), grams[:0], numbers[:0]
    yield sent()


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their counts, and ``more`` of them."""
    at = _find(keys, more)
    counts = counts.copy()
    counts[at[at >= 0]] += n[at >= 0]
    new = at < 0
    where = np.searchsorted(keys, more[new])
    return np.insert(keys, where, more[new]), np.insert(counts, where, n[new])


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``; -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Level:
    """Contexts of one length: their continuations, and what a step down from each costs (as log10)."""

    grams: np.ndarray
    log_count: np.ndarray
    context_of: np.ndarray  # place of each continuation's context
    contexts: np.ndarray
    distinct: np.ndarray
    whole: np.ndarray  # denominators and escapes if nothing is excluded
    escape: np.ndarray
    below: np.ndarray  # place of the suffix among the shorter contexts
    below_whole: np.ndarray  # the suffix's denominator and escape without the symbols of this context
    below_escape: np.ndarray


class Trie:
    """Contexts of 0 to ``order`` symbols, longest last, from their continuations (k, gram, count).

    A context of k symbols is a continuation of one of k - 1, so its total is that one's count; one
    that ends in START occurs once a text, as END does.  In a ``whole`` trie, which may lack other groups than
    its own, the total is the sum of the continuations.
    """

    def __init__(self, order: int, k: np.ndarray, gram: np.ndarray, count: np.ndarray, symbols: int, whole: bool = False):
        self.order, self.levels = order, []
        shorter = None
        for length in range(order + 1):
            own = np.flatnonzero(k == length)
            own = own[np.argsort(gram[own])]
            g, c = gram[own], count[own].astype(float)
            contexts, first, distinct = np.unique(g >> BITS, return_index=True, return_counts=True)
            kept = np.add.reduceat(c, first) if len(g) else np.zeros(0)
            below, lower = np.zeros(len(contexts), np.int32), (np.zeros(len(contexts)), np.zeros(len(contexts)))
            total = np.full(len(contexts), float(symbols))
            if shorter is not None and len(g):
                above, counts, sums = shorter
                if length == 1 and not whole:
                    texts = counts[_find(above.grams, np.array([END]))][0] if len(counts) else 0.0
                total = kept if whole else np.where(contexts & _mask(1) == START, texts, counts[_find(above.grams, contexts)])
                below = _find(above.contexts, contexts & _mask(length - 1))
                excluded = np.add.reduceat(counts[_find(above.grams, g & _mask(length))], first)
                t, r, d = (x[below] for x in sums)
                lower = self._step(t - excluded, r - excluded, d - distinct)
            sums = (total, kept, distinct.astype(float))
            level = Level(g, np.log10(c), np.repeat(np.arange(len(contexts), dtype=np.int32), distinct), contexts, distinct.astype(np.int32), *self._step(*sums), below.astype(np.int32), *lower)
            self.levels.append(level)
            shorter = level, c, sums

    @staticmethod
    def _step(total: np.ndarray, kept: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the denominator and of the escape; a context without anything left is passed for nothing."""
        whole = total + distinct
        some = whole > 0
        whole = np.where(some, whole, 1)
        return np.log10(whole), np.where(some, np.log10(np.maximum(np.where(some, total - kept + distinct, 1), 1e-300)) - np.log10(whole), 0.0)

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each packed gram."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        # Where the walk stands: the place of the longest known context, and whether its own symbols were excluded.
        known = np.full(len(grams), -1)
        for k in range(self.order, -1, -1):
            level, wanted = self.levels[k], grams[left] & _mask(k + 1)
            at = _find(level.grams, wanted)
            found, above = at >= 0, known >= 0
            # Symbols found: their context is known with them.
            n, own = np.flatnonzero(found & above), np.flatnonzero(found & ~above)
            out[left[n]] += level.log_count[at[n]] - (self.levels[k + 1].below_whole[known[n]] if len(n) else 0)
            out[left[own]] += level.log_count[at[own]] - level.whole[level.context_of[at[own]]]
            # Others: the escape of their context, if there is one, and on to its suffix.
            n, own = np.flatnonzero(~found & above), np.flatnonzero(~found & ~above)
            here = np.full(len(left), -1)
            if len(n):
                upper = self.levels[k + 1]
                out[left[n]] += upper.below_escape[known[n]]
                here[n] = upper.below[known[n]]
            here[own] = _find(level.contexts, wanted[own] >> BITS)
            own = own[here[own] >= 0]
            out[left[own]] += level.escape[here[own]]
            left, known = left[~found], here[~found]
        out[left] -= math.log10(max(1, SYMBOLS - (int(self.levels[0].distinct[0]) if len(self.levels[0].distinct) else 0)))
        return out

    def log_probability(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text with its end."""
        out = np.zeros(len(texts))
        for grams, starts, numbers in pieces(texts, self.order):
            different, where = np.unique(grams, return_inverse=True)
            np.add.at(out, numbers, np.add.reduceat(self.score(different)[where], starts))
        return out


def summed(gram: np.ndarray, count: np.ndarray, longest: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, gram, count) of contexts of ``longest`` symbols and of all shorter ones down to ``shortest``."""
    out = []
    for k in range(longest, shortest - 1, -1):
        gram, where = np.unique(gram & _mask(k + 1), return_inverse=True)
        count = np.bincount(where, count, len(gram)).astype(np.int64)
        out.append((np.full(len(gram), k), gram, count))
    k, gram, count = (np.concatenate(x) for x in zip(*out, strict=True))
    return k, gram, count


def group_of(gram, split: int, groups: int):
    """The group of a gram's contexts, by their last ``split`` symbols; of a column or of numbers."""
    if isinstance(gram, Column):
        mixed = (F.shiftright(gram, BITS).bitwiseAND(F.lit(_mask(split))) * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftright(mixed * F.lit(groups), 32)
    return (((gram >> BITS & _mask(split)) * 2654435761 & 0xFFFFFFFF) * groups) >> 32


#: What of a level is stored, a list each.
STORED = [f.name for f in dataclasses.fields(Level)]


def _store(levels: list[Level], folder: str, name: str) -> None:
    """Levels as an Arrow file, one a row; a file appears whole or not at all."""
    columns = [[getattr(level, f) for level in levels] for f in STORED]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.large_list(pa.from_numpy_dtype(c[0].dtype))) for c in columns], names=STORED)
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as sink, pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    files.move(part, f"{path}/{name}")


@cache
def _stored(folder: str, name: str) -> list[Level]:
    """Levels that were stored, mapped into memory; from a folder that is not local they are copied once a machine."""
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if not isinstance(files, pyarrow.fs.LocalFileSystem):
        here = os.path.join(tempfile.gettempdir(), f"{os.path.basename(folder)}-{name}")
        if not os.path.exists(here):
            part = f"{here}-{uuid.uuid4().hex}"
            pyarrow.fs.copy_files(path, part, source_filesystem=files, destination_filesystem=pyarrow.fs.LocalFileSystem())
            os.replace(part, here)
        path = here
    batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
    return [Level(*(batch.column(f)[i].values.to_numpy() for f in STORED)) for i in range(batch.num_rows)]


class StoredTrie(Trie):
    """All contexts: short ones held here, others in groups that are read from ``folder`` as they are needed."""

    def __init__(self, base: Trie, split: int, folder: str, groups: int, present: set[int]):
        self.order, self.levels = base.order, base.levels
        self.split, self.folder, self.groups, self.present = split, folder, groups, present

    def score(self, grams: np.ndarray) -> np.ndarray:
        out, group = np.zeros(len(grams)), group_of(grams, self.split, self.groups)
        order = np.argsort(group, kind="stable")
        numbers, first = np.unique(group[order], return_index=True)
        for number, own in zip(numbers.tolist(), np.split(order, first[1:]), strict=True):
            trie = Trie.__new__(Trie)
            trie.order, trie.levels = self.order, self.levels
            if number in self.present:
                trie.levels = self.levels[: self.split] + _stored(self.folder, str(number))
            out[own] = trie.score(grams[own])
        return out


def stored_trie(grams: DataFrame, order: int, symbols: int) -> StoredTrie:
    """The trie of all grams (gram, trained), built group by group in tasks.

    The driver gets the continuations of contexts shorter than SPLIT and the numbers of the groups.
    """
    split = min(SPLIT, order)
    short = grams.groupBy(F.col("gram").bitwiseAND(F.lit(_mask(split))).alias("gram")).agg(F.sum("trained").alias("n"), F.count("*").alias("longest")).toArrow()
    low = summed(short.column("gram").to_numpy(), short.column("n").to_numpy(), split - 1, 0)
    groups = max(grams.sparkSession.sparkContext.defaultParallelism, -(-sum(short.column("longest").to_pylist()) // GROUP_GRAMS))
    folder = shared_place(grams.sparkSession, "trie")

    def build(table: pa.Table) -> pa.Table:
        high = summed(table.column("gram").to_numpy(), table.column("trained").to_numpy(), order, split)
        trie = Trie(order, *(np.concatenate(x) for x in zip(low, high, strict=True)), symbols, whole=True)
        number = table.column("number")[0].as_py()
        _store(trie.levels[split:], folder, str(number))
        return pa.table({"number": pa.array([number], pa.int64())})

    own = grams.select(group_of(F.col("gram"), split, groups).cast("long").alias("number"), "gram", "trained")
    present = {r.number for r in own.groupBy("number").applyInArrow(build, "number long").collect()}
    return StoredTrie(Trie(order, *low, symbols, whole=True), split, folder, groups, present)


@dataclass
class Model:
    trie: Trie
    frequent: dict[bytes, int]  # training counts of frequent words
    rare: DataFrame  # word, trained: of the other words of training texts
    tokens: int
    distinct: int

    @property
    def whole(self) -> float:
        """Denominator of the word model."""
        return self.tokens + ADDED * (self.distinct + 1)


def trie_rows(grams: DataFrame, order: int, least: float) -> DataFrame:
    """(k, gram, n): the continuations of every order with a count of ``least`` and more.

    Counts of shorter contexts are sums of those of longer ones.
    """
    counts, out = grams.select("gram", F.col("trained").alias("n")), None
    for k in range(order, -1, -1):
        if k < order:
            counts = counts.groupBy(F.col("gram").bitwiseAND(F.lit(_mask(k + 1))).alias("gram")).agg(F.sum("n").alias("n"))
        own = counts.where(F.col("n") >= least).select(F.lit(k).alias("k"), "gram", "n")
        out = own if out is None else out.unionByName(own)
    return out


def train(docs: DataFrame, held_out: Column, text: str = "text", order: int = ORDER, least_share: float = LEAST_SHARE, frequent_share: float = FREQUENT_SHARE) -> Model:
    """Count all words and contexts of the texts that are not held out; null texts count as empty.

    All contexts count, however rare.  With a ``least_share`` above zero only those of that share do, and the whole trie of
    (order + 1) / least_share rows at most goes through the driver.  It gets 1 / frequent_share words at most.
    """
    if not 0 < order <= 6:
        raise ValueError("a context has from 1 to 6 bytes")
    own = docs.select(F.col(text).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    counts = own.mapInArrow(lambda batches: _counted(batches, order), "word string, gram long, trained long, total long")
    counts = checkpointed(counts.groupBy("word", "gram").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total")))
    grams = counts.where(F.col("gram").isNotNull())
    symbols = grams.agg(F.sum("trained")).first()[0] or 0
    if least_share > 0:
        rows = trie_rows(grams, order, symbols * least_share).toArrow()
        trie = Trie(order, *(rows.column(c).to_numpy() for c in ("k", "gram", "n")), symbols)
    else:
        trie = stored_trie(grams, order, symbols)
    vocabulary = counts.where(F.col("word").isNotNull())
    size = vocabulary.agg(F.sum("trained").alias("n"), F.sum("total").alias("total"), F.count_if(F.col("trained") > 0).alias("v")).first()
    hot = F.col("total") >= (size.total or 0) * frequent_share
    frequent = vocabulary.where(hot).select("word", "trained").toArrow()
    table = {w.encode(): n for w, n in zip(frequent.column("word").to_pylist(), frequent.column("trained").to_pylist(), strict=True)}
    return Model(trie, table, vocabulary.where(~hot & (F.col("trained") > 0)).select("word", "trained"), size.n or 0, size.v or 0)


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (of them only ``columns``, if given: texts are stored otherwise) with n_tokens, n_known, base_score and score, of whole texts.

    ``n_tokens`` counts words and one end; ``n_known`` those of training texts; ``base_score`` is the word
    model's log10 probability and ``score`` that of the trie, over all bytes and the end.  A null text counts as empty: an
    end alone.  Repeated rows are scored each on its own, columns of ``docs`` that clash with
    new ones are replaced, an empty table gives no rows.  A model of no training texts spreads its chances evenly.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.trie, {w: math.log10(n + ADDED) for w, n in model.frequent.items()}))
    whole, unseen = math.log10(model.whole), math.log10(ADDED)
    rare = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("times", T.LongType())]))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare_words", rare)]

    def compute():
        trie, frequent = sent.value

        def run(texts: list, _) -> list:
            rows = []
            for t in texts:
                found = Counter(words(t))
                found[END_TOKEN.encode()] = 1
                n, known, base, others = found.total(), 0, 0.0, []
                for w, times in found.items():
                    if (own := frequent.get(w)) is not None:
                        known += times if own > unseen else 0
                        base += times * own
                    else:
                        base += times * unseen
                        others.append({"word": w.decode(), "times": times})
                rows.append((n, known, base - n * whole, others))
            n, known, base, others = map(list, zip(*rows, strict=True))
            return [n, known, base, trie.log_probability(texts), others]

        return run

    # Until they meet their counts, rare words count as not seen.
    scored = append_columns(without(docs, ["scored_row", "more_known", "more_base"], keep=(text,)), text, fields, compute)
    if columns is not None:
        scored = scored.select(*columns, *(f.name for f in fields))
    found = checkpointed(scored).withColumn("scored_row", F.monotonically_increasing_id())
    more = found.select("scored_row", F.explode("rare_words").alias("r")).select("scored_row", "r.word", "r.times").join(model.rare, "word")
    gain = F.col("times") * (F.log10(F.col("trained") + ADDED) - unseen)
    more = more.groupBy("scored_row").agg(F.sum("times").alias("more_known"), F.sum(gain).alias("more_base"))
    out = found.join(more, "scored_row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("more_base", F.lit(0.0))})
    return out.drop("scored_row", "rare_words", "more_known", "more_base")
