"""A clock that rests set to the latest end: a prefix scan of max-plus matrices.

``clock = max(clock, end) + rest`` and ``end = max(end, clock + length)`` are linear where adding is
max and multiplying is plus.  Against a clock without that rule the real one runs ahead by a lift; from rest to
rest (lift, end) goes through a matrix of four numbers, and matrices combine in any grouping.  So runs
of them are multiplied in blocks, the blocks' products in larger blocks, and the state before each
block is handed down again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nothing: less than any tick.
NEVER = -(1 << 50)
#: Elements of a block, by level; above the last level the rest of a sequence stands in one row.
BLOCKS = (256, 4096)
STATE = "struct<lift:bigint,end:bigint>"


def matrix(ll: Column | int, le: Column | int, el: Column | int, ee: Column | int) -> Column:
    """lift' = max(lift + ll, end + le); end' = max(lift + el, end + ee)."""
    put = lambda v, n: (F.lit(v) if isinstance(v, int) else v).cast("long").alias(n)
    return F.struct(put(ll, "ll"), put(le, "le"), put(el, "el"), put(ee, "ee"))


def _dot(a: Column, b: Column, c: Column, d: Column) -> Column:
    # Sums of two nevers stay nevers.
    return F.greatest(a + b, c + d, F.lit(NEVER).cast("long"))


def product(later: Column, earlier: Column) -> Column:
    return F.struct(
        _dot(later.ll, earlier.ll, later.le, earlier.el).alias("ll"), _dot(later.ll, earlier.le, later.le, earlier.ee).alias("le"),
        _dot(later.el, earlier.ll, later.ee, earlier.el).alias("el"), _dot(later.el, earlier.le, later.ee, earlier.ee).alias("ee"),
    )


def applied(m: Column, state: Column) -> Column:
    return F.struct(_dot(m.ll, state.lift, m.le, state.end).alias("lift"), _dot(m.el, state.lift, m.ee, state.end).alias("end"))


def scan(rows: DataFrame, keys: Sequence[str], blocks: Sequence[int] = BLOCKS) -> DataFrame:
    """(keys, n, state): lift and end after the matrices ``m`` of ``rows`` (keys, n, m) up to number ``n``, in order.

    Numbers start from 0 and need not be dense.  The state before all is lift 0 and no end.
    """
    start = F.expr(f"cast(named_struct('lift', 0L, 'end', {NEVER}L) as {STATE})")
    if blocks:
        rows = rows.withColumn("block", F.expr(f"n div {blocks[0]}"))
        own = [*keys, "block"]
    else:
        own = list(keys)
    runs = rows.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("run"))
    if blocks:
        whole = F.aggregate("run", F.expr(f"named_struct('ll', 0L, 'le', {NEVER}L, 'el', {NEVER}L, 'ee', 0L)"), lambda p, x: product(x.m, p))
        ends = scan(runs.select(*keys, F.col("block").alias("n"), whole.alias("m")), keys, blocks[1:])
        # The state before a block is the last one of the blocks before it; blocks may be missing.
        ends = ends.select(*keys, F.col("n").alias("block"), "state")
        before = F.lag("state").over(Window.partitionBy(*keys).orderBy("block"))
        runs = runs.join(ends.select(*keys, "block", before.alias("before")), own)
        start = F.coalesce("before", start)
    kind = f"array<struct<n:bigint,state:{STATE}>>"
    first = F.struct(start.alias("state"), F.expr(f"cast(array() as {kind})").alias("out"))

    def step(x: Column, element: Column) -> Column:
        state = applied(element.m, x.state)
        return F.struct(state.alias("state"), F.array_append(x.out, F.struct(element.n.cast("long").alias("n"), state.alias("state"))).alias("out"))

    return runs.select(*keys, F.explode(F.aggregate("run", first, step).out).alias("x")).select(*keys, "x.n", "x.state")
