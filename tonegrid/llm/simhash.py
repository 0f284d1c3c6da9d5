"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits.  Of two fingerprints that differ in
at most 3 bits, one segment differs in at most 1: so the table of segments is probed with the
Hamming ball of radius 1 around each segment (33 keys) and every match is verified on all 64
bits.  Only different fingerprints are compared; equal ones share a row before any join.

A segment value that very many different fingerprints share is cut again: the other segments of
a linked pair differ in at most 3 bits, so at least one of their four bytes is equal, and the
bucket is split by (byte number, byte).  No bucket is capped.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import append_columns, set_aside
from .components import components
from .skew import hot_limit, joined
from .storage import checkpointed

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: A segment value shared by more different fingerprints than this is split by bytes of the other segment.
HOT_BUCKET = 2000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [h(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[k : k + (1 << 15)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fp``: the fingerprint as a signed long (null and blank texts: 0)."""
    return append_columns(docs, text, [T.StructField("fp", T.LongType())], lambda: lambda texts, _: [[x - (1 << 64) if x >> 63 else x for x in map(fingerprint, texts)]])


def _segments(fps: DataFrame) -> DataFrame:
    """(key, other, fp) per segment: key holds the segment's number and value, other the other segment."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    both = F.array(F.struct(low.alias("key"), high.alias("other")), F.struct(high.bitwiseOR(F.lit(1 << 32)).alias("key"), low.alias("other")))
    return fps.select("fp", F.explode(both).alias("s")).select("s.key", "s.other", "fp")


def _ball(key: Column) -> Column:
    """The keys within one bit of a segment."""
    return F.array(key, *(key.bitwiseXOR(F.lit(1 << i)) for i in range(32)))


def _bytes(other: Column) -> Column:
    return F.array(*(F.shiftright(other, 8 * i).bitwiseAND(F.lit(0xFF)) + F.lit(256 * i) for i in range(4)))


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of the different ``fp`` of ``fps`` that differ in 1 to 3 bits."""
    table = _segments(fps)
    probes = table.withColumn("key", F.explode(_ball(F.col("key"))))
    hot = checkpointed(table.groupBy("key").count().where(F.col("count") > hot_bucket).select("key"))

    def matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        left = left.withColumnRenamed("fp", "a")
        right = right.withColumnRenamed("fp", "b").drop("other").withColumnsRenamed({c: f"b_{c}" for c in on})
        same = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        for c in on:
            same = same & (F.col(c) == F.col(f"b_{c}"))
        return left.join(right, same).select("a", "b")

    if hot.isEmpty():
        return matched(probes, table, ["key"]).distinct()
    cold = matched(probes.join(hot, "key", "left_anti"), table.join(hot, "key", "left_anti"), ["key"])
    split = lambda df: df.join(hot, "key").withColumn("byte", F.explode(_bytes(F.col("other"))))
    return cold.union(matched(split(probes), split(table), ["key", "byte"])).distinct()


def _rooted(docs: DataFrame, doc_id: str, text: str, hot_bucket: int) -> DataFrame:
    """The rows of :func:`near_duplicates` with the least fingerprint of their component, ``root``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = with_fingerprint(own.withColumn("text_hash", F.xxhash64("text")), "text").select("doc_id", "text_hash", "fp")
    rows = checkpointed(rows)
    classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")))
    number = classes.agg(F.sum("rows").alias("rows"), F.count("*").alias("classes")).first()
    roots = components(links(classes.select("fp"), hot_bucket))
    rooted = classes.drop("rows").join(roots.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("linked_id"), F.count("*").alias("members"))
    linked = joined(rooted.select("fp", "root"), least, "root", "members", hot_limit(number.classes))
    ids = classes.join(linked, "fp", "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"), F.coalesce("linked_id", "least_id").alias("component_id"))
    # Equal texts may be a third of all rows; a fingerprint's row count is known.
    return joined(rows, checkpointed(ids), "fp", "rows", hot_limit(number.rows or 0)).select("doc_id", "text_hash", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per document: doc_id, text_hash (of the whole text), fp, component_id.

    ``component_id`` is the smallest doc_id whose document is reachable over links of at most 3
    differing bits, the document itself included.  Documents without words have fingerprint 0 and
    are linked like any other.  Null ids don't count for the minimum; a component of null ids only
    has a null component_id.  Repeated rows stay as they are.  An empty table gives no rows.
    """
    return _rooted(docs, doc_id, text, hot_bucket).drop("root")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component, whole: the one with the smallest id (then text digest); null ids last.

    Rows that repeat id and text count once; which of their other columns stay is not defined.
    """
    found = _rooted(docs, doc_id, text, HOT_BUCKET).withColumn("root", F.coalesce("component_id", "root"))
    rank = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_hash")
    first = found.groupBy(F.col("component_id").isNull(), "root").agg(F.min(rank).alias("kept")).select("kept.doc_id", "kept.text_hash").distinct()
    # Null-safe keys as plain columns of both sides, so that the join's exchange of whole rows serves the
    # aggregation too.
    keys = ["kept_id", "kept_void", "kept_hash"]
    keyed = lambda df, own, digest: df.withColumns(dict(zip(keys, (F.coalesce(own.cast("string"), F.lit("")), own.isNull(), digest), strict=True)))
    aside = set_aside(docs, keys)
    mine = docs.withColumnsRenamed(aside)
    mine = keyed(mine, F.col(f"`{aside.get(doc_id, doc_id)}`"), F.coalesce(F.xxhash64(F.col(f"`{aside.get(text, text)}`")), F.lit(0)))
    keep = keyed(first, F.col("doc_id"), F.coalesce("text_hash", F.lit(0))).select(*keys)
    one = mine.join(keep, keys).dropDuplicates(keys).drop(*keys)
    return one.withColumnsRenamed({b: a for a, b in aside.items()}).select([f"`{c}`" for c in docs.columns])
