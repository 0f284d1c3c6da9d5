"""Balanced contiguous shards from global byte-size prefix sums, in DataFrame functions only.

Rows are put in the order of a digest of their text, so that equal texts stand together.  Ranges
of that order are the partitions whose totals are summed up; prefix sums within a range and the
ranges' offsets give every row its place in the whole, which is cut at equal byte targets.  A
group of equal texts that is no larger than a fiftieth of a shard's target is never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed

#: Ranges of the digest order are powers of two between these, so that one holds about so many rows; rows of one
#: text are dealt to this many parts of it, or more where a part would hold more than so many rows.
LEAST_RANGES, MOST_RANGES, RANGE_ROWS = 1 << 12, 1 << 20, 1 << 16
LEAST_SALTS, SALT_ROWS = 1 << 10, 1 << 20
#: Groups of equal texts up to this share of a shard's target stay together.
GROUP_SHARE = 0.02
#: What a row counts beside the bytes of its text.
ROW_BYTES = 16


def _before(column: str, order: Window) -> Column:
    return F.coalesce(F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 length of the text (null: 0) plus ``row_bytes``; shards are contiguous in
    the digest order and near equal in bytes: a cut lies at most half of a largest row, or of a
    fiftieth of the target, from its target.  Slots run from 0 in every shard.  Null texts count as empty (crc32 0); rows that
    repeat in id and text are interchangeable and each get a slot; null ids come first among equal
    texts.  More shards than rows leave some empty; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("digest"), F.crc32(body).alias("text_crc32"), (F.octet_length(body).cast("long") + row_bytes).alias("size"))
    rows = checkpointed(rows)
    n = rows.count()
    bits = min(max(LEAST_RANGES, 1 << (n // RANGE_ROWS).bit_length()), MOST_RANGES).bit_length() - 1
    salt = F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(max(LEAST_SALTS, n // SALT_ROWS))).cast("int")
    part = F.shiftright("digest", 64 - bits).cast("int") + (1 << (bits - 1))
    rows = rows.withColumns({"salt": salt, "part": part})

    # Equal texts with one salt; their rows all have the same size.
    same = ["part", "digest", "text_crc32", "size"]
    parts = rows.groupBy(*same, "salt").agg(F.count("*").alias("n"))
    totals = parts.groupBy("part").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows"))
    whole = totals.agg(F.sum("bytes").alias("bytes")).first()  # one row
    if not whole.bytes:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = Window.orderBy("part")  # MOST_RANGES rows at most
    offsets = totals.select("part", _before("bytes", ranges).alias("range_bytes"), _before("rows", ranges).alias("range_rows"))
    inside = Window.partitionBy("part").orderBy("digest", "text_crc32", "size", "salt")
    group = Window.partitionBy("part", "digest", "text_crc32", "size")
    placed = (
        parts.withColumn("bytes", F.col("n") * F.col("size"))
        .withColumns({"bytes_before": _before("bytes", inside), "rows_before": _before("n", inside)})
        .withColumns({"group_start": F.min("bytes_before").over(group), "group_bytes": F.sum("bytes").over(group)})
        .join(F.broadcast(offsets), "part")  # MOST_RANGES rows at most
    )
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(*same, "salt").orderBy("doc_id")).cast("long") - 1)
    at = ranked.join(placed, [*same, "salt"])
    middle = F.when(
        F.col("group_bytes") <= GROUP_SHARE * whole.bytes / shards, F.col("group_start") + F.col("group_bytes") / 2
    ).otherwise(F.col("bytes_before") + F.col("k") * F.col("size") + F.col("size") / 2)
    number = F.least(F.floor((F.col("range_bytes") + middle) * shards / F.lit(whole.bytes)), F.lit(shards - 1)).cast("int")
    at = at.select("doc_id", "size", "text_crc32", number.alias("shard"), (F.col("range_rows") + F.col("rows_before") + F.col("k")).alias("place"))
    at = checkpointed(at)
    first = at.groupBy("shard").agg(F.min("place").alias("first"))  # `shards` rows at most
    return at.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
