"""Errors counted by stream without sorting tokens for every kind of error."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tonegrid.config import TokenizerConfig
from tonegrid.plans.tokenizer import Tokenizer

COLUMNS = "score_id long, seq_idx int, pos long, token string"


def streams(tokenizer, seed: int) -> list:
    """Tokens drawn from a few of each type, others the vocabulary doesn't have, and null."""
    rng, by_type = random.Random(seed), {}
    for name in tokenizer.vocabulary.parts[0]:
        by_type.setdefault(name.partition("_")[0], []).append(name)
    few = [rng.sample(names, min(2, len(names))) for kind, names in by_type.items() if kind.isalpha() and kind not in ("PAD", "BOS", "EOS", "MASK")]
    few = [names for names in few if names[0].partition("_")[2] != "None" or names[0].startswith("Bar")] + [["Odd_1", None]]
    return [(score, seq, pos, rng.choice(rng.choice(few))) for score in range(3) for seq in range(2) for pos in range(250)]


CASES = [("TSD", {}), ("REMI", {}), ("MIDILike", {}), ("TSD", {"use_pitch_intervals": True}), ("MIDILike", {"one_token_stream_for_programs": False}), ("REMI", {"remove_duplicated_notes": False})]


@pytest.mark.parametrize(("name", "changes"), CASES)
def test_counts_are_sums_of_errors(spark, name, changes):
    flags = {"use_programs": True, "remove_duplicated_notes": True, "use_rests": True, "use_tempos": True, "use_time_signatures": True}
    t = Tokenizer.of(name, TokenizerConfig(**(flags | changes)))
    rows = spark.createDataFrame(streams(t, 5), COLUMNS)
    by = F.sum(F.col("bad_type").cast("long") + F.col("bad_note").cast("long") + F.col("bad_time").cast("long"))
    expected = t.errors(rows).groupBy("score_id", "seq_idx").agg(F.count("*").alias("n_tokens"), by.alias("n_errors"))
    found = t.error_counts(rows).select("score_id", "seq_idx", "n_tokens", "n_errors")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert found.where("n_errors > 0 and n_tokens = 250").count() == 6


@pytest.mark.parametrize(("name", "sorts"), [("TSD", 1), ("REMI", 1), ("MIDILike", 2)])
def test_tokens_are_sorted_once(spark, name, sorts):
    """On/off tokens once more by pitch, only those of them that open or close a note."""
    t = Tokenizer.of(name, TokenizerConfig(use_programs=True, remove_duplicated_notes=True))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = t.error_ratio(spark.createDataFrame([], COLUMNS))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Sort [") == sorts
    assert "Join" not in plan
