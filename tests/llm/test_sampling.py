from __future__ import annotations

import logging

from tonegrid.llm.sampling import held_out, labelled_sample


def test_labels_without_a_usable_document_do_not_use_up_the_sample(spark, caplog):
    docs = spark.createDataFrame([(i, None if i % 10 == 3 else "x" * (200 if i % 10 == 4 else 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    with caplog.at_level(logging.WARNING):
        sample = labelled_sample(docs, labels, "quality", 5, 0, 30, 100)
    assert len(sample) == 30 and {y for _, y in sample} == {0, 1} and not caplog.records
    kept = docs.where(~held_out("doc_id", 5, 0)).where("length(text) <= 100").count()
    assert len(labelled_sample(docs, labels, "quality", 5, 0, 1000, 100)) == kept


def test_a_sample_of_one_label_is_logged(spark, caplog):
    docs = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, text string")
    with caplog.at_level(logging.WARNING):
        labelled_sample(docs, docs.selectExpr("doc_id", "1 as quality"), "quality", 5, 0, 30, 100)
    assert len(caplog.records) == 1 and "quality" in caplog.text
