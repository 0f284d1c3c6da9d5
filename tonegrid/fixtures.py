"""Scores made from the shared test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.scores import ScoreTables

TPQ = 480


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("score_id"),
        (line - 1).cast("int").alias("track_idx"),
        F.when(line == 7, -1).otherwise((line - 1) * 8).cast("int").alias("program"),
        ((F.col("l_orderkey") * 13 + line * 11) % 61440).alias("time"),
        (30 + (F.col("l_partkey") * 7 + line * 53) % 1920).alias("duration"),
        (15 + F.col("l_partkey") % 100).cast("int").alias("pitch"),
        (1 + F.col("l_quantity").cast("int") * 2).cast("int").alias("velocity"),
    )


def score_tables(spark: SparkSession, sf_dir: str) -> ScoreTables:
    """All tables of the scores: one score per supplier, one track per line number."""
    supplier, k = table(spark, sf_dir, "supplier").select("s_suppkey"), F.explode(F.sequence(F.lit(0), F.lit(3)))
    four = supplier.select("s_suppkey", k.alias("seq"))
    key = F.col("s_suppkey")
    tempos = four.select(key.alias("score_id"), "seq", (F.col("seq") * 15360).cast("long").alias("time"), (F.lit(60000000.0) / (40 + (key * 17 + F.col("seq") * 29) % 211)).alias("mspq"))
    kind = (key + F.col("seq")) % 4
    signatures = four.select(
        key.alias("score_id"),
        "seq",
        (F.col("seq") * 15360 + (F.col("seq") * key) % 400).cast("long").alias("time"),
        F.when(kind == 0, 4).when(kind == 1, 3).when(kind == 2, 6).otherwise(2).cast("int").alias("num"),
        F.when(kind == 2, 8).otherwise(4).cast("int").alias("den"),
    )
    lines = table(spark, sf_dir, "lineitem")
    time = ((F.col("l_orderkey") * 13) % 61440).alias("time")
    pedals = lines.where("l_linenumber = 1").select(F.col("l_suppkey").alias("score_id"), F.lit(0).alias("track_idx"), F.lit(0).alias("program"), time, (100 + F.col("l_partkey") % 700).alias("duration"))
    bends = lines.where("l_linenumber = 2").select(
        F.col("l_suppkey").alias("score_id"), F.lit(1).alias("track_idx"), F.lit(8).alias("program"), time, ((F.col("l_partkey") * 37) % 16384 - 8192).cast("int").alias("value")
    )
    scores = supplier.select(key.alias("score_id"), F.lit(TPQ).alias("tpq"))
    return ScoreTables(scores, notes(spark, sf_dir), tempos, signatures, pedals, bends)
