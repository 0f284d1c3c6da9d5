"""Joins with a side of one row a key, whose hot keys are known by count and joined apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, and more than LEAST_ROWS.
SHARE, LEAST_ROWS = 10_000, 1000


def hot_limit(rows: int) -> int:
    """Rows above which a key is hot; at most SHARE keys can be."""
    return max(LEAST_ROWS, rows // SHARE)


def joined(many: DataFrame, one: DataFrame, key: str, weight: str, limit: int) -> DataFrame:
    """``many`` joined with ``one`` on ``key``, without the column ``weight`` of ``one``.

    ``one`` has each key once and ``weight`` says how many rows of ``many`` have it.  Rows of hot
    keys meet them in a broadcast of at most SHARE rows (as ``limit`` is :func:`hot_limit` of the rows of ``many``), so no key
    gathers in a task; all others meet in an ordinary join.
    """
    hot, cold = one.where(F.col(weight) > limit).drop(weight), one.where(F.col(weight) <= limit).drop(weight)
    # The hot keys' rows have no match in `cold` and the others none in `hot`: both joins are inner ones.
    apart = many.join(F.broadcast(hot), key)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return apart.unionByName(rest)
