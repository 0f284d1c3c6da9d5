"""Column expressions shared by the operators: lookups on small grids, ticks, rounding, token names."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_array(values: Sequence, kind: str) -> Column:
    """A constant array column of the given element type (folded once by the optimizer)."""
    text = json.dumps(list(values)).replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"from_json('{text}', 'array<{kind}>')")


def lookup(values: Sequence, index: Column, kind: str = "int") -> Column:
    """``values[index]`` of a small constant table; null outside."""
    return F.get(literal_array(values, kind), index.cast("int"))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def nearest_bin(x: Column, bins: Sequence[float], kind: str = "double") -> Column:
    """The nearest bin, of two as near the larger; for values without a small lookup table."""
    near = F.transform(literal_array(bins, kind), lambda b: F.struct(F.abs(b - x).alias("far"), (-b).alias("minus"), b.alias("bin")))
    return F.array_min(near).getField("bin")


def quotient(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    divisor = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, divisor)


def half_even(x: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(x).cast("long")


def ticks_per_beat(tpq: Column, denominator: Column) -> Column:
    return quotient(tpq * 4, denominator)


def qpm_to_mspq(qpm: Column) -> Column:
    """Quarters per minute to microseconds per quarter (and the other way round)."""
    return F.lit(60000000.0) / qpm


def two_decimals(x: Column) -> Column:
    """Two decimals, of which one trailing zero is dropped."""
    return F.regexp_replace(F.format_string("%.2f", x.cast("double")), "0$", "")


def by_value(x: Column, cases: Sequence[int], expression: Callable[[int], Column]) -> Column:
    """``expression(case)`` for the case that ``x`` equals; null for none."""
    out = None
    for case in cases:
        out = F.when(x == case, expression(case)) if out is None else out.when(x == case, expression(case))
    return out


def token(kind: Column | str, value: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v.cast("string")
    return F.concat(lit(kind), F.lit("_"), lit(value))


def token_type(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def token_value(name: Column) -> Column:
    return F.substring_index(name, "_", -1)


def linspace(start: float, end: float, count: int) -> Column:
    """An array of ``count`` numbers at equal steps from ``start`` to ``end``, both included (one: the start)."""
    if count < 2:
        return literal_array([float(start)] * count, "double")
    step = (float(end) - float(start)) / (count - 1)
    return literal_array([*(float(start) + step * i for i in range(count - 1)), float(end)], "double")


def histogram_bin(x: Column, edges: Column) -> Column:
    """The number of the bin that holds ``x`` between ascending edges, the last edge included; null outside."""
    passed = F.size(F.filter(edges, lambda e: e <= x))
    last = F.size(edges) - 1
    inside = (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(inside, F.least(passed, last) - 1)


def histogram(rows: DataFrame, keys: Sequence[str], x: Column, edges: Column) -> DataFrame:
    """(keys, bin, n): how many values of a group lie in each bin, empty bins included."""
    found = rows.select(*keys, histogram_bin(x, edges).alias("bin"))
    groups = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.size(edges) - 2)).alias("bin"))
    counts = found.where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return groups.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
