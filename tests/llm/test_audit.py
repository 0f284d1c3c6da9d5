"""The filter audit against walking every order over every document."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tonegrid.llm import audit
from tonegrid.llm.queries import queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i}" for i in range(120))
DOCS = [
    (1, "short text", "en"), (2, "short text", "de"), (2, "short text", "de"), (3, "", "en"), (4, None, None), (5, LONG, "en"), (6, LONG, ""), (7, LONG + " #", "en"),
    (8, "same word " * 200, "en"), (9, LONG.upper(), "fr"), (None, "short text", "en"), (None, LONG, None), (10, "a b\x0bc\x0cd\x1ce É\U0001f600 A", "en"), (11, "|" * 50, None),
    (12, "A" + "é" * 9, "es"), (13, "A" + "é" * 8, "es"), (14, "big " * 60_000 + "$", "en"), (15, LONG + "  \n ", "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (None, 1, 1), (5, 1, 1), (6, 1, 0), (9, 1, None), (99, 1, 1), (14, 0, 1)]


def failures(docs):
    """(part, letters that the row fails) of each row."""
    for i, t, part in docs:
        t = t or ""
        w = WORDS.findall(t)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t))]
        tests.append(i is not None and any(j is not None and j < i and (s or "") == t for j, s, _ in docs))
        yield part or "", "".join(c for c, bad in zip("ABCDE", tests, strict=True) if bad)


def walked(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows = [(p, f, i in good, i in toxic) for (p, f), (i, _, _) in zip(failures(docs), docs, strict=True)]
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, c in enumerate(order):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                shapley[c] += len(gone)
                out[part, order, k + 1] = (len(left), len(gone), sum(c in r[1] for r in own) - len(gone), sum(r[1] == c for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for key in [k for k in out if k[0] == part]:
            out[key] += (shapley[key[1][key[2] - 1]],)
    return out


def test_every_order_on_every_part(spark, tmp_path):
    rows = [(*r, 7, "x") for r in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, A int, part string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries()["op11_filter_audit"](spark, str(tmp_path))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found.schema["step"].dataType.typeName() == "integer" and {found.schema[c].dataType.typeName() for c in found.columns[3:]} == {"long"}
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == walked(DOCS, LABELS)
    assert found.count() == 600 * 5


def test_joint_failures_and_their_inversion(spark):
    flags = [(1, 0, 1, 2), (1, 1, 1, 1), (0, 0, 0, 5), (0, 1, 1, 0)]
    rows = spark.createDataFrame([("p", *f) for f in flags], "part string, x long, y long, z long, w long")
    joint = audit.joint_failures(rows, ("x", "y", "z"), ("w",)).select("*", audit.survivors("all", 3).alias("kept"), audit.survivors("w", 3).alias("kept_w"), audit.shapley("all", 3).alias("v")).first()
    within = lambda r, s: [f for f, k in zip(r[:3], range(3), strict=True) if s >> k & 1]
    assert list(joint["all"]) == [sum(all(within(r, s)) for r in flags) for s in range(8)]
    assert list(joint.kept) == [sum(not any(within(r, s)) for r in flags) for s in range(8)]
    assert list(joint.kept_w) == [sum(r[3] for r in flags if not any(within(r, s))) for s in range(8)]
    assert sum(joint.v) == 6 * 3


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", 1), ("p", 0)], "part string, only long")
    assert [tuple(r) for r in audit.audit(rows, ("only",)).collect()] == [("p", "only", 1, 1, 1, 0, 1, 1)]
    assert audit.audit(rows.where(F.lit(False)), ("only",)).count() == 0
    with pytest.raises(ValueError):
        audit.audit(rows, ())


def test_a_text_of_a_third_of_all_rows(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    assert audit.flag_texts(docs).agg(F.sum("E")).first()[0] == 2999
