"""The bounded sample of labelled rows on which the classifiers are fitted."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, folds: int, fold: int):
    """Column: whether crc32 of the id as text, modulo ``folds``, is ``fold`` (null ids: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) of labelled documents outside the held-out fold.

    Rows are taken by the least hash of the id, so the sample is the same on every run and does not
    depend on the order of rows.  Texts of more than ``max_chars`` characters are not sampled, so
    that ``rows * max_chars`` bounds what reaches the driver.  Null ids, labels and texts are left
    out; of repeated labels of an id the largest counts.  Labels without a document that can be
    sampled don't count towards ``rows``.  A sample without both labels is logged as a warning.
    """
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg(F.max(label).alias("sampled_label"))
        .join(own.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # The right side has at most `rows` rows.
    found = own.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows)
    sample = [(r.text, int(r.sampled_label)) for r in found.select("text", "sampled_label").collect()]
    if len({y for _, y in sample}) < 2:
        logging.getLogger(__name__).warning("the sample for label %s has %d rows and not both labels: every text gets one score", label, len(sample))
    return sample
