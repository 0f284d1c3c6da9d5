"""A Merkle manifest of a dataset: one tree per group of rows, one tree over the groups' roots.

Trees are built by events.  A node is an event for its parent: a partial parent collects the
digests of its children by their index until it has as many as the size of the tree gives it,
then it becomes a node and an event itself.  Every task does this with the leaves it reads; what
stays partial there, a few nodes at the ends of its runs, is dealt again by the subtree it belongs to, in
rounds, until all parents are met.

Of every STRATUM-th level the nodes are kept.  Proofs are made from the root down by these
reverse links: a node of a kept level hands the way above it to the block of nodes below it, so that no
task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed

ARITY = 3
#: Levels from one kept level to the next: a block has ARITY ** STRATUM nodes at most.
STRATUM = 6
BLOCK = ARITY**STRATUM
#: Ranges in which leaves are numbered hold about so many rows, or fewer where the session asks for more partitions.
RANGE_ROWS = 1 << 22
#: A task sends partial parents on when it has so many, whatever order its leaves come in.
MOST_PARTIAL = 100_000

OPEN, KEPT, ROOT = 0, 1, 2
NODE = "tree string, size long, level int, place long, digest string, state int"
NODE_ARROW = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("state", pa.int32())])
PATH = "array<struct<before:string,after:string>>"


def joint_digest(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A field of a leaf: its byte count, a colon and its value as text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256)


def nodes_at(size: int, level: int) -> int:
    """Nodes of a level of a tree of ``size`` leaves."""
    return -(-size // ARITY**level)


class Partial:
    """Parents that wait for children; the combiner of a task, and of a block of a frontier."""

    def __init__(self):
        self.parents: dict[tuple[str, int, int, int], dict[int, str]] = {}

    def add(self, tree: str, size: int, level: int, place: int, digest: str) -> Iterator[tuple]:
        """Take a node; yields nodes of kept levels and roots that it completes."""
        while True:
            count = nodes_at(size, level)
            if count == 1 or level and level % STRATUM == 0:
                yield tree, size, level, place, digest, ROOT if count == 1 else KEPT
            if count == 1:
                return
            above = place // ARITY
            children = self.parents.setdefault((tree, size, level + 1, above), {})
            children[place] = digest
            if len(children) < min(ARITY, count - ARITY * above):
                return
            del self.parents[tree, size, level + 1, above]
            level, place, digest = level + 1, above, joint_digest(children[k] for k in sorted(children))

    def rest(self) -> Iterator[tuple]:
        """The children of partial parents, to be sent on."""
        for (tree, size, level, _), children in self.parents.items():
            yield from ((tree, size, level - 1, k, d, OPEN) for k, d in children.items())
        self.parents = {}


def _nodes(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [()] * 6, NODE_ARROW.types, strict=True)]


def _first_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    partial = Partial()
    for batch in batches:
        out = [n for t, s, p, d in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n in partial.add(t, s, 0, p, d)]
        if len(partial.parents) > MOST_PARTIAL:
            out += partial.rest()
        yield pa.RecordBatch.from_arrays(_nodes(out), schema=NODE_ARROW)
    yield pa.RecordBatch.from_arrays(_nodes(list(partial.rest())), schema=NODE_ARROW)


def _fold(frontier: pa.Table) -> pa.Table:
    """What the events of a subtree complete; those of kept levels are known already."""
    partial = Partial()
    kept = [n for row in zip(*(frontier[c].to_pylist() for c in ("tree", "size", "level", "place", "digest")), strict=True) for n in partial.add(*row) if n[2] > row[2]]
    return pa.Table.from_arrays(_nodes(kept + list(partial.rest())), schema=NODE_ARROW)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``place`` (from 0 within ``tree`` by ``order``, nulls first) and ``size`` (rows of the tree).

    Numbers come from the counts of ranges of the whole order, so that a tree of any share of the rows is
    spread over many tasks.
    """
    leaves = checkpointed(leaves)
    ranges = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), leaves.count() // RANGE_ROWS + 1)
    # The tie spreads rows that are the same throughout; their order is of no consequence.
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, "tree", *order, "tie").withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt.drop("tie"))
    tree = Window.partitionBy("tree")  # a row per range at most
    spans = dealt.groupBy("part", "tree").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("part", "tree", before.alias("first"), F.sum("n").over(tree).alias("size"))
    rank = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order))
    at = dealt.withColumn("rank", rank).join(spans, ["part", "tree"])
    return checkpointed(at.withColumn("place", F.col("first") + F.col("rank") - 1).drop("part", "first", "rank"))


def build(leaves: DataFrame) -> DataFrame:
    """Kept nodes and roots of the trees of numbered ``leaves`` (tree, size, place, digest), as NODE rows."""
    nodes = checkpointed(leaves.select("tree", "size", "place", "digest").mapInArrow(_first_fold, NODE))
    done, height = [nodes.where(F.col("state") != OPEN)], STRATUM
    frontier = nodes.where(F.col("state") == OPEN)
    while not frontier.isEmpty():
        # All children of a parent below this height have the same ancestor there.
        span = F.element_at(F.array(*(F.lit(ARITY**k).cast("long") for k in range(height, 0, -1))), F.least("level", F.lit(height - 1)) + 1)
        blocks = frontier.where(F.col("level") < height).withColumn("span", span).withColumn("block", F.expr("place div span"))
        folded = blocks.groupBy("tree", "block").applyInArrow(_fold, NODE)
        nodes = checkpointed(folded.unionByName(frontier.where(F.col("level") >= height)))
        done.append(nodes.where(F.col("state") != OPEN))
        frontier, height = nodes.where(F.col("state") == OPEN), height + STRATUM
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _way(level: int, names: list[str]):
    """Function of a block's nodes and the way above it: its nodes, each with its whole way to the root."""

    def run(members: pa.Table, context: pa.Table) -> pa.Table:
        places, digests = members["place"].to_pylist(), members["digest"].to_pylist()
        above = context["path"][0].as_py() if len(context) else []
        size = members["size"][0].as_py() if len(members) else 0
        nodes, steps, k = dict(zip(places, digests, strict=True)), [], level
        while k < level + STRATUM and nodes_at(size, k) > 1:
            runs: dict[int, list[int]] = {}
            for p in sorted(nodes):
                runs.setdefault(p // ARITY, []).append(p)
            step = {}
            for run_ in runs.values():
                own = [nodes[p] for p in run_]
                step |= {p: ("".join(own[:i]), "".join(own[i + 1 :])) for i, p in enumerate(run_)}
            steps.append(step)
            nodes, k = {p: joint_digest(nodes[c] for c in run_) for p, run_ in runs.items()}, k + 1
        divisors = [ARITY**i for i in range(len(steps))]
        ways = [s[p // d] for p in places for s, d in zip(steps, divisors, strict=True)]
        top = [(x["before"], x["after"]) for x in above]
        if top:
            n = len(steps)
            ways = [x for i in range(len(places)) for x in (*ways[i * n : (i + 1) * n], *top)]
        length = len(steps) + len(top)
        flat = pa.StructArray.from_arrays([pa.array([b for b, _ in ways], pa.string()), pa.array([a for _, a in ways], pa.string())], names=["before", "after"])
        paths = pa.ListArray.from_arrays(pa.array([i * length for i in range(len(places) + 1)], pa.int32()), flat)
        subroots = pa.array([context["subroot"][0].as_py() if len(context) else None] * len(places), pa.string())
        return pa.Table.from_arrays([*(members[c].combine_chunks() for c in names), subroots, paths], names=[*names, "subroot", "path"])

    return run


def prove(leaves: DataFrame, nodes: DataFrame, outer: DataFrame, carry: list[str]) -> DataFrame:
    """``tree``, ``place``, ``size``, ``digest`` and ``carry`` of each of the numbered ``leaves``, with ``subroot`` and ``path``.

    ``outer`` gives for each tree its subroot and the path above it.  A path lists, level by level from
    the leaf, what the digests of its siblings are: those before it and those after it, joined.
    """
    nodes = checkpointed(nodes)
    sizes = nodes.where(F.col("state") == ROOT).select("tree", "size")
    tops = checkpointed(outer.select("tree", "subroot", "path").join(sizes, "tree"))
    most, strata = sizes.agg(F.max("size")).first()[0] or 1, 0
    while nodes_at(most, STRATUM * (strata + 1)) > 1:
        strata += 1
    ways = None
    for s in range(strata, -1, -1):
        own = ["tree", "size", "place", "digest", *(carry if s == 0 else [])]
        members = leaves if s == 0 else nodes.where((F.col("level") == STRATUM * s) & (F.col("state") == KEPT))
        reach = F.col("size") <= ARITY ** (STRATUM * (s + 1))
        context = tops.where(reach & (F.col("size") > ARITY ** (STRATUM * s)) if s else reach).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "path")
        if ways is not None:
            context = context.unionByName(ways.select("tree", F.col("place").alias("block"), "subroot", "path"))
        blocks = members.select(*own, F.expr(f"place div {BLOCK}").alias("block"))
        kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + f", subroot string, path {PATH}"
        ways = blocks.groupBy("tree", "block").cogroup(context.groupBy("tree", "block")).applyInArrow(_way(STRATUM * s, own), schema)
        if s:
            ways = checkpointed(ways)
    return ways


def manifest(docs: DataFrame, fields: list[str], doc_id: str = "doc_id", group: str = "source", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, group, place, leaf, subroot, root, path, and the columns ``extra``.

    A leaf is the SHA-256 of ``fields``.  Leaves of a group ascend by doc_id (null first; equal ids by
    leaf, and rows that are the same in all are interchangeable); groups ascend bytewise, null first.  Every ARITY nodes in turn become
    their parent while more than one remains.  ``path`` proves the leaf: :func:`folded` with it gives
    ``root``.  Other columns of ``docs`` are not looked at.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    extra = extra or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree")
    leaves = numbered(docs.select(F.col(doc_id).alias("doc_id"), tree, leaf_digest([F.col(f) for f in fields]).alias("digest"), *(c.alias(k) for k, c in extra.items())), ["doc_id", "digest"])
    nodes = checkpointed(build(leaves))
    groups = numbered(nodes.where(F.col("state") == ROOT).select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), ["own"])
    above = checkpointed(build(groups))
    root = above.where(F.col("state") == ROOT).first()  # one row, none for an empty table
    start = spark.range(1).select(F.lit("").alias("tree"), F.lit("").alias("subroot"), F.array().cast(PATH).alias("path"))
    outer = prove(groups, above, start, ["own"]).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path")
    proved = prove(leaves, nodes, outer, ["doc_id", *extra])
    name = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return proved.select("doc_id", name.alias("group"), "place", F.col("digest").alias("leaf"), "subroot", F.lit(root and root.digest).cast("string").alias("root"), "path", *extra)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda d, step: F.sha2(F.concat(step.before, d, step.after).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.before, s.after)), "").cast("binary"), 256)
