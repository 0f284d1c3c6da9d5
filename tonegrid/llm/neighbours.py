"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample and kept as an in-memory graph.  Every vector is posted
to its nearest centroid and, near a boundary, to further ones whose distance is within a ratio of
the nearest.  A query walks the graph to its nearest centroids, keeps the lists within a ratio of
the distance at which enough rows are covered, and meets their vectors in a join on the list; long
lists are dealt to parts, which all get the query, so a task's share of a list is bounded whatever
one vector or region weighs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import checkpointed

#: Rows that centroids are fitted on at most; rows of a list aimed at (each counted once); most lists.
SAMPLE_ROWS, LIST_ROWS, MAX_LISTS = 20_000, 128, 4096
#: Boundary vectors: lists a vector is posted to at most, within this ratio of its nearest distance.
REPLICAS, POST_RATIO = 8, 1.2
#: Share of the lists that a query may probe, at any size, and the least of them; beyond these, within this ratio
#: of the distance of the list with which more than k rows are covered.
PROBE_SHARE, PROBE_LEAST, PROBE_RATIO = 0.05, 16, 1.25
#: Centroids that a walk looks at first.
ENTRIES = 512
#: Rows of a posting list, and queries, that one group compares.
PART_ROWS, QUERY_PART = 4096, 512


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


@dataclass
class CentroidGraph:
    """Centroids, each with its nearest ones as neighbours, and entries spread over them."""

    centroids: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, degree: int = 20, entries: int = ENTRIES) -> CentroidGraph:
        k = len(centroids)
        near = []
        for i in range(0, k, 512):
            d = squared(centroids[i : i + 512], centroids)
            near.append(np.argsort(d, axis=1)[:, 1 : degree + 1])
        edges = np.vstack(near) if k > 1 else np.zeros((k, 1), np.int64)
        if k > 1:  # the last neighbours are links to anywhere, so that every centroid can be reached
            far = np.random.default_rng(3).integers(0, k, (k, 4))
            edges = np.hstack([edges, far])
        return cls(centroids, edges, np.unique(np.linspace(0, k - 1, min(k, entries)).astype(np.int64)))

    def nearest(self, vectors: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search: centroid numbers and distances, nearest first, for a batch of vectors.

        All entries are looked at; from the nearest of them the walk of each vector goes on along
        the edges until no centroid in its beam is left to be expanded, several at a time.
        """
        n, k = len(vectors), len(self.centroids)
        count = min(count, k)
        beam = min(k, max(2 * count, 24))
        step = max(4, beam // 16)
        norm = (self.centroids * self.centroids).sum(1)
        own = (vectors * vectors).sum(1)
        d = np.maximum(own[:, None] - 2 * vectors @ self.centroids[self.entries].T + norm[self.entries], 0)
        if len(self.entries) == k:  # nothing is left to be walked to
            some = np.argpartition(d, count - 1, axis=1)[:, :count]
            d = np.take_along_axis(d, some, 1)
            order = np.lexsort((some, d), axis=1)
            return np.take_along_axis(some, order, 1), np.sqrt(np.take_along_axis(d, order, 1))
        first = np.argpartition(d, min(beam, d.shape[1]) - 1, axis=1)[:, :beam]
        seen = np.zeros((n, k), bool)
        seen[:, self.entries] = True
        ids, dist = self.entries[first], np.take_along_axis(d, first, 1)
        done = np.zeros(ids.shape, bool)
        while len(live := np.flatnonzero(~done.all(1))):
            # The nearest ones not expanded yet; a row with fewer of them expands some again, which adds nothing.
            at = np.argsort(np.where(done[live], np.inf, dist[live]), axis=1, kind="stable")[:, :step]
            done[live[:, None], at] = True
            new = np.sort(self.edges[ids[live[:, None], at]].reshape(len(live), -1), axis=1)
            fresh = ~seen[live[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]  # a centroid twice among the new ones counts once
            seen[live[:, None], new] = True
            row, col = np.nonzero(fresh)
            found = np.full(new.shape, np.inf)
            found[row, col] = np.maximum(own[live[row]] - 2 * np.einsum("nd,nd->n", vectors[live[row]], self.centroids[new[row, col]]) + norm[new[row, col]], 0)
            all_d, all_i = np.hstack([dist[live], found]), np.hstack([ids[live], new])
            all_done = np.hstack([done[live], ~fresh])
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if all_d.shape[1] > beam else np.broadcast_to(np.arange(all_d.shape[1]), all_d.shape)
            if best.shape[1] > dist.shape[1]:  # fewer entries than the beam has room for
                pad = best.shape[1] - dist.shape[1]
                dist, ids = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf), np.pad(ids, ((0, 0), (0, pad)))
                done = np.pad(done, ((0, 0), (0, pad)), constant_values=True)
            dist[live], ids[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_done))
        order = np.argsort(dist, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from sampled rows; after each, centroids of few rows move to the largest clusters."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for r in range(rounds):
        label = np.concatenate([squared(sample[i : i + 4096], centroids).argmin(1) for i in range(0, len(sample), 4096)])
        size = np.bincount(label, minlength=lists)
        total = np.stack([np.bincount(label, sample[:, j], lists) for j in range(sample.shape[1])], axis=1)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
        if r + 1 < rounds:  # balance
            mean = len(sample) / lists
            small, large = np.flatnonzero(size < mean / 4), np.flatnonzero(size > 2 * mean)
            large = large[np.argsort(-size[large])]
            for s, g in zip(small, large, strict=False):
                centroids[s] = sample[rng.choice(np.flatnonzero(label == g))]
    return centroids


def probed_lists(lists: int, share: float = PROBE_SHARE) -> int:
    """How many of the lists a query may probe."""
    return min(lists, max(PROBE_LEAST, int(lists * share)))


def covering(d: np.ndarray, held: np.ndarray, k: int, probes: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of each query's lists to probe, and whether those given hold more than ``k`` rows.

    ``d`` are the distances, nearest first, and ``held`` the rows whose nearest centroid is the
    list's, so that none counts twice.  Kept are the lists up to the one with which more than ``k``
    rows are covered, the nearest PROBE_LEAST, and of the first ``probes`` those within ``ratio``
    of that one's distance: the nearest alone may lie on the query and hold few rows.
    """
    there = np.isfinite(d)
    enough = np.cumsum(np.where(there, held, 0), axis=1) > k
    full = enough[:, -1]
    last = np.where(full, enough.argmax(1), d.shape[1] - 1)[:, None]
    place = np.arange(d.shape[1])
    near = d <= ratio * np.take_along_axis(d, last, 1) + 1e-12
    return there & ((place <= last) | (place < PROBE_LEAST) | (near & (place < probes))), full


def probed(graph: CentroidGraph, x: np.ndarray, held: np.ndarray, k: int, probes: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that the queries ``x`` probe; they hold ``k`` rows besides each query, or all rows."""
    ids, d = graph.nearest(x, probes)
    keep, full = covering(d, held[ids], k, probes, ratio)
    row, col = np.nonzero(keep & full[:, None])
    rows, lists = [row], [ids[row, col]]
    if len(short := np.flatnonzero(~full)):  # the lists found hold too few rows: all are ranked
        every = np.sqrt(squared(x[short], graph.centroids))
        order = np.argsort(every, axis=1, kind="stable")
        keep, _ = covering(np.take_along_axis(every, order, 1), held[order], k, probes, ratio)
        row, col = np.nonzero(keep)
        rows, lists = [*rows, short[row]], [*lists, order[row, col]]
    return np.concatenate(rows), np.concatenate(lists)


def usable(vector: Column) -> Column:
    """Whether a vector is there, not zero, and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    list_rows: int = LIST_ROWS,
    probe_share: float = PROBE_SHARE,
    probe_ratio: float = PROBE_RATIO,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest other rows found, all if there are fewer.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller vec_id, ranks run from 1.  Null and zero vectors, vectors with null or non-finite
    components, null ids and vectors of another dimension than the most frequent one take no part.
    Rows that repeat an id count once (the least vector).  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    element = vectors.schema[embedding].dataType.elementType
    kept = F.col(embedding) if isinstance(element, T.FloatType) else F.col(embedding).cast("array<double>")
    own = vectors.select(F.col(vec_id).alias("vec_id"), kept.alias("v"), is_query.alias("q")).where(usable(F.col("v").cast("array<double>")) & F.col("vec_id").isNotNull())
    own = checkpointed(own.groupBy("vec_id").agg(F.min(F.struct("v", "q")).alias("x")).select("vec_id", "x.v", "x.q"))
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    id_type = own.schema["vec_id"].dataType
    result = T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    if not sizes:
        return spark.createDataFrame([], result)
    dimension, n = sizes[0].d, sizes[0].n
    own = own.where(F.size("v") == dimension)
    lists = min(MAX_LISTS, max(1, -(-n // list_rows)))
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(min(SAMPLE_ROWS, n)).toArrow()
    graph = CentroidGraph.of(fit_centroids(_matrix(sample.column("v").combine_chunks(), dimension), lists))
    lists = len(graph.centroids)
    probes = probed_lists(lists, probe_share)
    sent = spark.sparkContext.broadcast(graph)  # MAX_LISTS centroids at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                x = _matrix(b.column(1), dimension)
                ids, d = g.nearest(x, REPLICAS)
                row, col = np.nonzero(d <= POST_RATIO * d[:, :1] + 1e-12)
                take = pa.array(row)
                query = b.column(2).fill_null(False).take(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, col].astype(np.int32)), pa.array(col == 0), query, b.column(0).take(take), b.column(1).take(take)], names=["list", "home", "query", "vec_id", "v"]
                )

    of_list = [T.StructField("list", T.IntegerType())]
    row_fields = [T.StructField("vec_id", id_type), own.schema["v"]]
    flags = [T.StructField("home", T.BooleanType()), T.StructField("query", T.BooleanType())]
    posted = checkpointed(own.mapInArrow(post, T.StructType(of_list + flags + row_fields)))
    held = np.zeros(lists, np.int64)
    for r in posted.where("home").groupBy("list").agg(F.count("*").alias("n")).collect():  # MAX_LISTS rows at most
        held[r["list"]] = r.n

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                row, target = probed(g, _matrix(b.column(1), dimension), held, k, probes, probe_ratio)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(target.astype(np.int32)), b.column(0).take(take), b.column(1).take(take)], names=["list", "vec_id", "v"])

    routed = checkpointed(posted.where("home and query").select("vec_id", "v").mapInArrow(route, T.StructType(of_list + row_fields)))
    # Long lists are dealt to parts; a list's queries go to each of them, themselves in parts.
    count = lambda df, name, rows: df.groupBy("list").agg(F.ceil(F.count("*") / rows).alias(name))
    parts = F.broadcast(count(posted, "parts", PART_ROWS).join(count(routed, "query_parts", QUERY_PART), "list"))  # MAX_LISTS rows at most
    salt = lambda m: F.pmod(F.xxhash64("vec_id"), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m.cast("int") - 1))
    data = posted.join(parts, "list").select("list", salt(F.col("parts")).alias("part"), every(F.col("query_parts")).alias("query_part"), "vec_id", "v")
    asked = routed.join(parts, "list").select(
        F.col("list").alias("list"), every(F.col("parts")).alias("part"), salt(F.col("query_parts")).alias("query_part"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left.column("v").combine_chunks(), dimension), left.column("vec_id").combine_chunks()
            y, asks = _matrix(right.column("v").combine_chunks(), dimension), right.column("vec_id").combine_chunks()
            by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            x, ids = x[by_id], ids.take(pa.array(by_id))
            names, own_names = ids.to_numpy(zero_copy_only=False), asks.to_numpy(zero_copy_only=False)
            norm = (x * x).sum(1)
            for j in range(0, len(y), 64):
                asked = y[j : j + 64]
                near = norm - 2 * asked @ x.T + (asked * asked).sum(1)[:, None]
                near[names == own_names[j : j + 64][:, None]] = np.inf
                # Rounding of these squares is far below the slack; whatever may be among the nearest is measured exactly.
                slack = 1e-9 * (norm.max() + (asked * asked).sum(1))
                limit = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(asked), np.finfo(float).max)
                for i, some in enumerate(near <= (limit + slack)[:, None]):
                    some = np.flatnonzero(some & np.isfinite(near[i]))
                    delta = x[some] - asked[i]
                    d = np.sqrt((delta * delta).sum(1))
                    best = np.argsort(d, kind="stable")[:k]
                    columns[0].append(np.full(len(best), i + j))
                    columns[1].append(some[best])
                    columns[2].append(d[best])
        if not columns[0]:
            none = pa.array([], left.schema.field("vec_id").type)
            return pa.table({"query_id": none, "vec_id": none, "score": pa.array([], pa.float64())})
        row, best, score = (np.concatenate(c) for c in columns)
        return pa.table({"query_id": asks.take(pa.array(row)), "vec_id": ids.take(pa.array(best)), "score": pa.array(score, pa.float64())})

    keys = ["list", "part", "query_part"]
    near = T.StructType([result["query_id"], result["vec_id"], result["score"]])
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, near).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*result.names)
