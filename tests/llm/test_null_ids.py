from __future__ import annotations

from pyspark.sql import functions as F

from tonegrid.llm import simhash


def test_a_component_of_null_ids_keeps_one_row(spark, monkeypatch):
    monkeypatch.setattr(simhash, "with_fingerprint", lambda df, text: df.withColumn("fp", F.length(text).cast("long")))
    # Fingerprints 1 and 3 differ in one bit, 252 from both in more than three.
    docs = spark.createDataFrame([(None, "a"), (None, "aaa"), (None, "bbb"), (None, "c" * 252)], "doc_id long, text string")
    lengths = sorted(len(r.text) for r in simhash.deduplicate(docs).collect())
    assert len(lengths) == 2 and lengths[0] in (1, 3) and lengths[1] == 252
