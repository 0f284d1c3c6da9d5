"""As-of lookups by merged order: boundaries and rows in one window, the last boundary carried on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements of an array that is searched by sorting.
SHORT = 64


def as_of(rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark_at: str, values: Sequence[str]) -> DataFrame:
    """``rows`` with the ``values`` of the last of ``marks`` of their keys whose ``mark_at`` is not after their ``at``.

    Null where there is none before.  What a row costs doesn't depend on how many marks there are, and
    neither rows nor marks of a key are gathered; marks at one place count in an undefined order.
    """
    kinds = {f.name: f.dataType for f in marks.schema.fields}
    kind = "struct<" + ",".join(f"`{v}`:{kinds[v].simpleString()}" for v in values) + ">"
    left = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_rank"), F.struct(*(F.col(c) for c in rows.columns)).alias("_row"), F.lit(None).cast(kind).alias("_mark"))
    right = marks.select(*keys, F.col(mark_at).alias("_at"), F.lit(0).alias("_rank"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_mark"))
    order = Window.partitionBy(*keys).orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_mark", F.last_value("_mark", ignoreNulls=True).over(order))
    return both.where("_row is not null").select("_row.*", "_mark.*")


def last_not_after(array: str, start: Callable[[Column], Column], x: Column) -> Column:
    """The place of the last element of a sorted array whose ``start`` (a whole number) is not after ``x``, from 0.

    The first element counts as not after anything; an empty array gives 0.  In a short array it is where ``x`` + 1
    sorts in, which Spark compiles; a longer one is bisected, in lambdas, which it interprets.
    """
    size = F.size(array)
    after = x.cast("long") + 1
    sorted_in = F.array_position(F.sort_array(F.concat(start(F.col(array)), F.array(after))), after)
    short = F.coalesce(F.greatest(sorted_in - 2, F.lit(0)), F.lit(0)).cast("int")
    halvings = F.ceil(F.log2(F.greatest(size, F.lit(1)))).cast("int")
    steps = F.transform(F.sequence(halvings, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    long = F.aggregate(steps, F.lit(0), lambda place, step: F.when((place + step < size) & (start(F.get(F.col(array), place + step)) <= x), place + step).otherwise(place))
    return F.when(size > SHORT, long).otherwise(short)
