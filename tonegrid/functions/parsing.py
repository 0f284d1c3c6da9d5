"""Token names taken apart: as column expressions, and as functions of SQL (plain SQL bodies, no Python runs)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Tokens whose value is a span, ``beats.position.resolution``.
SPANS = ("Duration", "TimeShift", "Rest")


def _numbers(value: Column, pattern: str, names: tuple[str, ...], what: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"not {what}: "), value))
    parts = F.struct(*(F.regexp_extract(value, pattern, i + 1).cast("int").alias(n) for i, n in enumerate(names)))
    return F.when(value.isNull(), F.lit(None)).when(value.rlike(pattern), parts).otherwise(bad)


def span_parts(value: Column) -> Column:
    """(beats, position, resolution) of ``1.2.8``; an error for anything else, null for null."""
    return _numbers(value, r"^(\d{1,9})\.(\d{1,9})\.([1-9]\d{0,8})$", ("beats", "position", "resolution"), "a span")


def span_to_ticks(value: Column, ticks_per_beat: Column) -> Column:
    """Ticks of a span: ``(beats * resolution + position) * ticks_per_beat`` by resolution, rounded down."""
    p = span_parts(value)
    return F.call_function("div", (p.beats.cast("long") * p.resolution + p.position) * ticks_per_beat, p.resolution)


def signature_parts(value: Column) -> Column:
    """(num, den) of ``3/4``; an error for anything else, null for null."""
    return _numbers(value, r"^([1-9]\d{0,8})/([1-9]\d{0,8})$", ("num", "den"), "a time signature")


def register_functions(spark: SparkSession) -> None:
    """Make ``token_fields(token)``, a table function, and ``span_ticks(value, ticks_per_beat)`` known to ``spark.sql``.

    ``token_fields`` gives one row per token: type, value, and what the value holds: beats, position and resolution
    of a span, num and den of a time signature, or a whole number; null where it holds none of them.
    """
    spans = ", ".join(f"'{s}'" for s in SPANS)
    # Parts are found by plain search: a regular expression for each would make methods too long for the JVM to compile.
    part = lambda value, mark, i: f"substring_index(substring_index({value}, '{mark}', {i}), '{mark}', -1)"
    marks = lambda value, mark: f"length({value}) - length(replace({value}, '{mark}', ''))"
    number = lambda value, mark, i: f"try_cast({part(value, mark, i)} AS INT)"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION token_fields(token STRING)
RETURNS TABLE (type STRING, value STRING, beats INT, position INT, resolution INT, num INT, den INT, number INT)
RETURN SELECT type, value, {number("span", ".", 1)}, {number("span", ".", 2)}, {number("span", ".", 3)}, {number("sides", "/", 1)}, {number("sides", "/", 2)}, try_cast(value AS INT)
FROM (SELECT type, value, CASE WHEN type IN ({spans}) AND {marks("value", ".")} = 2 THEN value END AS span, CASE WHEN type = 'TimeSig' AND {marks("value", "/")} = 1 THEN value END AS sides
FROM (SELECT substring_index(token_fields.token, '_', 1) AS type, CASE WHEN instr(token_fields.token, '_') > 0 THEN substr(token_fields.token, instr(token_fields.token, '_') + 1) END AS value))"""
    )
    whole = lambda i: f"CAST({part('value', '.', i)} AS BIGINT)"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION span_ticks(value STRING, ticks_per_beat BIGINT) RETURNS BIGINT
RETURN CASE WHEN {marks("value", ".")} < 2 THEN CAST(raise_error(concat('not a span: ', value)) AS BIGINT)
ELSE ({whole(1)} * {whole(3)} + {whole(2)}) * ticks_per_beat div {whole(3)} END"""
    )
