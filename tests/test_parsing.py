"""Token names taken apart by column expressions and by functions of SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tonegrid.functions.parsing import register_functions, signature_parts, span_parts, span_to_ticks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_spans_and_signatures(spark):
    assert tuple(one(spark, "1.2.8", span_parts)) == (1, 2, 8) and tuple(one(spark, "12/16", signature_parts)) == (12, 16)
    assert one(spark, None, span_parts) is None and one(spark, None, signature_parts) is None
    ticks = lambda v, tpb: one(spark, v, lambda c: span_to_ticks(c, F.lit(tpb).cast("long")))
    assert ticks("1.2.8", 16) == 20 and ticks("0.1.8", 4) == 0 and ticks("12.0.4", 480) == 5760
    for bad in ("1.2", "1.2.0", "a.b.c", "", "1.2.8 ", "-1.2.8"):
        with pytest.raises(Exception, match="not a span"):
            one(spark, bad, span_parts)
    for bad in ("3", "0/4", "3/4/5", ""):
        with pytest.raises(Exception, match="not a time signature"):
            one(spark, bad, signature_parts)


def test_functions_of_sql(spark):
    register_functions(spark)
    names = ["Pitch_60", "Duration_1.2.8", "TimeSig_6/8", "Chord_C:maj", "Bar_None", "Tempo_46.77", "odd", "Rest_1.2", "PitchBend_-512", "A_b_c", None]
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, token string").createOrReplaceTempView("some_tokens")
    rows = spark.sql("SELECT i, f.* FROM some_tokens, LATERAL token_fields(token) AS f ORDER BY i").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("Pitch", "60", None, None, None, None, None, 60), ("Duration", "1.2.8", 1, 2, 8, None, None, None), ("TimeSig", "6/8", None, None, None, 6, 8, None),
        ("Chord", "C:maj", None, None, None, None, None, None), ("Bar", "None", None, None, None, None, None, None), ("Tempo", "46.77", None, None, None, None, None, None),
        ("odd", None, None, None, None, None, None, None), ("Rest", "1.2", None, None, None, None, None, None), ("PitchBend", "-512", None, None, None, None, None, -512),
        ("A", "b_c", None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
    ]
    assert spark.sql("SELECT span_ticks('1.2.8', 16) AS a, span_ticks(NULL, 16) AS b").first() == (20, None)
