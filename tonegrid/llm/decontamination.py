"""Benchmark decontamination with suffix arrays over the training documents.

Every block of documents is a shard: its words are numbered, the suffix array of the shard is
sorted by prefix doubling, and every benchmark suffix is searched in it by bisection.  The
interval of suffixes that share a whole window with the benchmark suffix gives all its places;
from each place the match is followed to its full length along every item that has the window.

What can't match takes no part: words of a block outside of runs whose three-word grams all occur in
the benchmark are left out of the array, and benchmark suffixes with a gram that the block lacks are
not searched.  So a block costs a look-up for each of its words and for each benchmark word, and
sorting and bisection only for what the two share.

The shards need no exchange: the benchmark (a stated query set) goes to the executors in blocks
of checked size, the documents stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import append_columns, set_aside, without
from .storage import checkpointed

#: A-Z to lower case, every byte that is no word byte to a blank; UTF-8 bytes from 0x80 are word bytes.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Words looked up at a time to see what can match at all; bits of a gram's mark, and of those that a block's table takes.
GRAM, MARK_BITS, BLOCK_BITS = 3, 26, 22
#: Pairs of a hit and a place in the benchmark that are followed at a time.
PAIRS_AT_A_TIME = 1_000_000

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LONGEST = T.StructType(
    [T.StructField("words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType())]
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words (UTF-8) of a text; none for null."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def prefix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``text`` by their first ``depth`` words (0 is a separator and ends a suffix).

    Ranks of twice the length come from pairs of ranks; the last step joins two overlapping prefixes,
    so equal ranks mean exactly that the first ``depth`` words are equal.
    """
    n, rank, known = len(text), text.astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:]
        _, rank = np.unique(np.where(text > 0, rank * (int(rank.max(initial=0)) + 1) + ahead, 0), return_inverse=True)
        known += step
    return rank


def left_in_run(text: np.ndarray) -> np.ndarray:
    """How many words follow from each place to the next separator, itself included."""
    gaps = np.append(np.flatnonzero(text == 0), len(text))
    at = np.arange(len(text))
    return gaps[np.searchsorted(gaps, at)] - at


def has_gram(text: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words stand at a place before the next separator."""
    word = text > 0
    out = word.copy()
    for k in range(1, size):
        out[: max(len(text) - k, 0)] &= word[k:]
        out[max(len(text) - k, 0) :] = False
    return out


def gram_marks(text: np.ndarray, size: int) -> np.ndarray:
    """For each place a number of MARK_BITS bits that follows from its first ``size`` words."""
    n, mark = len(text), np.zeros(len(text), np.uint64)
    for k in range(size):
        mark *= np.uint64(0x9E3779B97F4A7C15)
        mark[: max(n - k, 0)] += text[k:].astype(np.uint64)
    mark ^= mark >> np.uint64(29)
    mark *= np.uint64(0xBF58476D1CE4E5B9)
    return (mark >> np.uint64(64 - MARK_BITS)).astype(np.int32)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true places."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    first = np.append(True, np.diff(at) > 1)
    start = at[first]
    return start, np.diff(np.append(np.flatnonzero(first), len(at)))


@dataclass
class Queries:
    """Numbered benchmark words and one query for each different window, all of one kind of length.

    ``stream`` has the word numbers of all items, 0 between items; every suffix of it that holds a
    whole window is a place of its query.  ``item_at`` and ``word_at`` tell the item and the word of
    a place.  ``least`` is the length of the shortest window, ``gram`` how many words are looked up
    at a time to see which windows can occur at all.
    """

    vocabulary: dict[bytes, int]
    stream: np.ndarray
    items: list[str]
    item_at: np.ndarray
    word_at: np.ndarray
    start: np.ndarray  # of each query: its first place in stream
    depth: np.ndarray  # of each query: words of its window
    first: np.ndarray  # of each query: where its places begin in `places`; one more at the end
    places: np.ndarray
    query_at: np.ndarray  # of each place of stream: the query whose first place it is, or -1
    least: int
    gram: int
    marks: np.ndarray  # of each place of stream
    known: np.ndarray  # which marks occur, eight to a byte

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int | None) -> Queries:
        """``window`` words a query; None: each item is one."""
        vocabulary: dict[bytes, int] = {}
        numbered = [np.zeros(1, np.int64)]
        for _, own in items:
            numbered += [np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in own), np.int64, len(own)), np.zeros(1, np.int64)]
        stream = np.concatenate(numbered)
        size = np.array([len(own) for _, own in items], np.int64)
        begin = np.cumsum(np.append(1, size + 1))[:-1]
        item_at = np.append(-1, np.repeat(np.arange(len(items)), size + 1)).astype(np.int32)
        word_at = np.append(0, np.arange(1, len(stream)) - np.repeat(begin, size + 1)).astype(np.int32)
        left = left_in_run(stream)
        if window is None:
            at, depth, kind = begin, size, {}
            same = np.array([kind.setdefault(stream[a : a + d].tobytes(), len(kind)) for a, d in zip(at.tolist(), depth.tolist(), strict=True)], np.int64)
        else:
            at = np.flatnonzero(left >= window)
            depth, same = np.full(len(at), window, np.int64), prefix_ranks(stream, window)[at]
        order = np.lexsort((at, same))
        at, depth, same = at[order], depth[order], same[order]
        new = np.flatnonzero(np.append(True, np.diff(same) != 0)) if len(at) else np.zeros(0, np.int64)
        least = int(depth.min(initial=1 << 30))
        gram = max(1, min(GRAM, least))
        marks = gram_marks(stream, gram)
        known = np.zeros(1 << MARK_BITS, bool)
        known[marks[has_gram(stream, gram)]] = True
        query_at = np.full(len(stream), -1, np.int32)
        query_at[at[new]] = np.arange(len(new))
        return cls(vocabulary, stream.astype(np.int32), [i for i, _ in items], item_at, word_at, at[new], depth[new], np.append(new, len(at)), at, query_at, least, gram, marks, np.packbits(known, bitorder="little"))


def benchmark_queries(items: list[tuple[str, str | None]], window: int) -> list[Queries]:
    """The queries of all items: whole windows, and items that are shorter than one."""
    split = [(i, words(t)) for i, t in items]
    return [Queries.of(own, w) for own, w in (([x for x in split if len(x[1]) >= window], window), ([x for x in split if 0 < len(x[1]) < window], None)) if own]


def suffix_array(text: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (0 is a separator), sorted by their first ``depth`` words.

    Suffixes with fewer than ``least`` words before the next separator are left out.
    """
    starts = np.flatnonzero((text > 0) & (left_in_run(text) >= least))
    return starts[np.argsort(prefix_ranks(text, depth)[starts], kind="stable")]


def bisect(windows: np.ndarray, depth: np.ndarray, text: np.ndarray, sa: np.ndarray, upper: bool) -> np.ndarray:
    """For every window (a row, 0 beyond its depth) the first place in ``sa`` whose suffix is not below (upper: is above) it."""
    lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(sa), np.int64)
    reach = np.arange(windows.shape[1])
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        there = text[np.minimum(sa[mid][:, None] + reach, len(text) - 1)]
        diff = np.where(reach < depth[live][:, None], there - windows[live], 0)
        first = np.take_along_axis(diff, np.argmax(diff != 0, axis=1)[:, None], 1)[:, 0]
        below = first <= 0 if upper else first < 0
        lo[live] = np.where(below, mid + 1, lo[live])
        hi[live] = np.where(below, hi[live], mid)
    return lo


def shard_of(q: Queries, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a block's words that can hold a window, with separators between, and where its words lie.

    A window's grams all occur in the benchmark, so whatever lies outside of long enough runs of
    such grams can't match; neither can words beyond a run extend a match.
    """
    mark = gram_marks(whole, q.gram)
    start, length = runs((q.known[mark >> 3] >> (mark & 7) & 1).astype(bool) & has_gram(whole, q.gram))
    long = length >= q.least - q.gram + 1
    edge = np.zeros(len(whole) + 1, np.int32)
    np.add.at(edge, start[long], 1)
    np.add.at(edge, start[long] + length[long] + q.gram - 1, -1)
    kept = np.cumsum(edge)[:-1] > 0
    with_gap = kept.copy()
    with_gap[1:] |= kept[:-1]
    place = np.flatnonzero(with_gap)
    return np.where(kept, whole, 0)[place], place


def possible(q: Queries, text: np.ndarray) -> np.ndarray:
    """The queries all of whose grams occur in ``text``."""
    there, shift = np.zeros(1 << BLOCK_BITS, bool), MARK_BITS - BLOCK_BITS
    there[gram_marks(text, q.gram)[has_gram(text, q.gram)] >> shift] = True
    start, length = runs(there[q.marks >> shift])
    long = length >= q.least - q.gram + 1
    start, length = start[long], length[long]
    n = length - (q.least - q.gram)  # places from which the shortest window stays in the run
    left = np.repeat(length, n) - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    asked = q.query_at[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    return asked[(asked >= 0) & (left >= q.depth[asked] - q.gram + 1)]


def in_benchmark(q: Queries, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hit, place in stream) of every hit with every place of its query, in parts."""
    count = q.first[of + 1] - q.first[of]
    cut = np.searchsorted(np.cumsum(count), np.arange(PAIRS_AT_A_TIME, int(count.sum()) + PAIRS_AT_A_TIME, PAIRS_AT_A_TIME))
    for hits in np.split(np.arange(len(of)), np.unique(cut)):
        n = count[hits]
        hit = np.repeat(hits, n)
        if len(hit):
            yield hit, q.places[np.repeat(q.first[of[hits]] - np.cumsum(n) + n, n) + np.arange(len(hit))]


def followed(q: Queries, text: np.ndarray, start: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words that match from ``start`` in the text and ``place`` in the benchmark, of which ``length`` are known to."""
    length, live = length.copy(), np.arange(len(start))
    while len(live):
        here = text[np.minimum(start[live] + length[live], len(text) - 1)]
        live = live[(here == q.stream[np.minimum(place[live] + length[live], len(q.stream) - 1)]) & (here > 0)]
        length[live] += 1
    return length


def search(q: Queries, tokens: list[list[bytes]]) -> dict[int, tuple[list, set, tuple]]:
    """For texts (as words) with matches: merged spans, matching items, the longest match."""
    get = q.vocabulary.get
    numbered = [np.zeros(1, np.int64)]
    for w in tokens:
        numbered += [np.fromiter((get(x, 0) for x in w), np.int64, len(w)), np.zeros(1, np.int64)]
    whole = np.concatenate(numbered)
    begin = np.cumsum([1, *(len(w) + 1 for w in tokens)])[:-1]  # where each text starts in whole
    text, place = shard_of(q, whole)
    asked = possible(q, text) if len(text) else np.zeros(0, np.int64)
    if not len(asked):
        return {}
    most = int(q.depth[asked].max())
    sa = suffix_array(text, most, q.least)
    depth, reach = q.depth[asked], np.arange(most)
    windows = np.where(reach < depth[:, None], q.stream[np.minimum(q.start[asked][:, None] + reach, len(q.stream) - 1)], 0)
    lo, hi = bisect(windows, depth, text, sa, False), bisect(windows, depth, text, sa, True)
    size = hi - lo
    if not size.sum():
        return {}
    of = np.repeat(asked, size)
    at = sa[np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(of))]
    here = place[at]
    doc = np.searchsorted(begin, here, side="right") - 1
    best: dict[int, tuple] = {}
    owners: dict[int, set] = {}
    for hit, source in in_benchmark(q, of):
        for d, i in zip(*(x.tolist() for x in np.divmod(np.unique(doc[hit] * len(q.items) + q.item_at[source]), len(q.items))), strict=True):
            owners.setdefault(d, set()).add(q.items[i])
        # A match that goes on to the left is part of a longer one that is met there.
        opens = (text[at[hit] - 1] != q.stream[source - 1]) | (text[at[hit] - 1] == 0)
        hit, source = hit[opens], source[opens]
        length = followed(q, text, at[hit], source, q.depth[of[hit]])
        # The longest of a document; of several the one that begins first there, then the least item.
        order = np.lexsort((here[hit], -length, doc[hit]))
        own = doc[hit][order]
        first = np.append(True, np.diff(own) != 0)[: len(own)]
        top = order[first][np.cumsum(first) - 1]
        for i in order[(length[order] == length[top]) & (here[hit[order]] == here[hit[top]])].tolist():
            d, s = int(doc[hit[i]]), int(source[i])
            found = (-int(length[i]), int(here[hit[i]] - begin[d]), q.items[q.item_at[s]], int(q.word_at[s]))
            best[d] = min(best.get(d, found), found)
    out: dict[int, tuple[list, set, tuple]] = {}
    order = np.lexsort((here, doc))
    for group in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        d = int(doc[group[0]])
        start = here[group] - begin[d]
        end = np.maximum.accumulate(start + q.depth[of[group]])
        new = np.append(True, start[1:] > end[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(group) - 1)
        n, at_word, item, word = best[d]
        out[d] = (list(zip(start[new].tolist(), end[last].tolist(), strict=True)), owners[d], (-n, at_word, item, word))
    return out


def joined(a: tuple, b: tuple) -> tuple:
    """Two findings for one text as one."""
    longer = min((x for x in (a[2], b[2]) if x), key=lambda x: (-x[0], *x[1:]), default=None)
    return merged(a[0] + b[0]), a[1] | b[1], longer


def search_all(queries: list[Queries], texts: list[str | None]) -> tuple[list[int], dict[int, tuple[list, set, tuple]]]:
    """Words of each text, and what :func:`search` finds for any of the queries."""
    tokens, found = [words(t) for t in texts], {}
    for q in queries:
        for d, own in search(q, tokens).items():
            found[d] = joined(found[d], own) if d in found else own
    return [len(w) for w in tokens], found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, text: str, item: str, max_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks whose summed text size was measured to be about ``max_bytes`` at most."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-total // max_bytes)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield sorted(map(tuple, block.distinct().collect()), key=lambda r: (r[0], r[1] or ""))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", benchmark_text: str = "text", window: int = 10, max_block_bytes: int = 16 << 20
) -> DataFrame:
    """``docs`` with its benchmark matches.

    Appends ``n_words`` (long), ``spans`` (merged word ranges that windows of the benchmark cover),
    ``items`` (distinct ids of the items with a window there, as strings, sorted) and ``longest``
    (words, start, item and item_start of the longest verbatim match, of several the first in the
    text, then the least item and place in it; null without a match).

    A null or empty text has no words and no matches; an item without words matches nothing; an
    item of fewer than ``window`` words is one window; a null item id counts as the empty string.
    Repeated documents and items are each handled on their own; columns of ``docs`` with the names
    above are replaced.  A benchmark of more than ``max_block_bytes`` is searched block by block,
    with what was found so far checkpointed in between, so no broadcast is larger.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", LONGEST)]
    out, sc = None, docs.sparkSession.sparkContext
    blocks = benchmark_blocks(benchmark, benchmark_text, item, max_block_bytes)
    for block in blocks:
        sent = sc.broadcast(benchmark_queries(block, window))
        prior = out is not None
        source = checkpointed(out).withColumnsRenamed({f.name: f"prior_{f.name}" for f in fields[1:]}) if prior else docs

        def compute(sent=sent, prior=prior):
            q = sent.value

            def run(texts: list, part: pa.RecordBatch) -> list:
                counts, found = search_all(q, texts)
                rows = [found.get(i, ([], set(), None)) for i in range(len(texts))]
                if prior:
                    before = [part.column(part.schema.get_field_index(f"prior_{f.name}")).to_pylist() for f in fields[1:]]
                    rows = [joined(r, ([(s["start"], s["end"]) for s in a], set(b), c and tuple(c.values()))) for r, a, b, c in zip(rows, *before, strict=True)]
                names = [f.name for f in LONGEST.fields]
                return [counts, [[{"start": a, "end": b} for a, b in r[0]] for r in rows], [sorted(r[1]) for r in rows], [dict(zip(names, r[2], strict=True)) if r[2] else None for r in rows]]

            return run

        out = append_columns(source, text, fields, compute)
        out = without(out, [f"prior_{f.name}" for f in fields[1:]]) if prior else out
    if out is None:  # an empty benchmark
        out = append_columns(docs, text, fields, lambda: lambda texts, _: [search_all([], texts)[0], [[]] * len(texts), [[]] * len(texts), [None] * len(texts)])
    return out


def hit_words(spans: str = "spans"):
    """Column: words that the merged ``spans`` cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with the columns of ``docs``."""
    aside = set_aside(docs, ["n_words", "spans", "items", "longest"])
    found = find_contamination(docs.withColumnsRenamed(aside), benchmark, **options)
    clean = found.where(F.size("items") == 0).drop("n_words", "spans", "items", "longest")
    return clean.withColumnsRenamed({b: a for a, b in aside.items()}).select([f"`{c}`" for c in docs.columns])
