"""Methods that Spark generates for streams stay short enough for the JVM to compile them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegrid import queries as music
from tonegrid.operators import scores, timing
from tonegrid.operators.asof import last_not_after

#: The JVM interprets methods of more bytes.
LONGEST = 8000


def test_rests_and_shifts_are_compiled(spark):
    c = music.tokenizer("TSD", **music.FULL).config
    events = spark.createDataFrame([], "score_id long, seq_idx int, time long, cls int, track int, src int, seq long, sub int, type string, value string, program int, note_end long")
    sections = spark.createDataFrame([], f"score_id long, sections array<{scores.SECTION}>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = timing.rest_and_shift(events, scores.ScoreTables(events, events, sections=sections), c)
        code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and 0 < max(sizes) <= LONGEST


def test_short_arrays_with_equal_starts_and_nulls(spark):
    rows = [([0, 5, 5, 9], x) for x in (None, -1, 0, 4, 5, 8, 9, 99)] + [([], 3), (None, 3)]
    frame = spark.createDataFrame(rows, "a array<long>, x long").withColumn("at", last_not_after("a", lambda s: s, F.col("x")))
    assert [r["at"] for r in frame.collect()] == [0, 0, 0, 0, 2, 2, 3, 3, 0, 0]
