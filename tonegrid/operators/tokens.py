"""Token sequences in long form: ids, bytes, slices, splits and concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import token_type
from ..vocabulary import Vocabulary
from .asof import as_of


def _known(column: str, looked_up: str):
    """The looked-up value; an error where the vocabulary lacks the key."""
    unknown = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.col(column).cast("string")))
    return F.when(F.col(looked_up).isNotNull(), F.col(looked_up)).otherwise(unknown)


def to_ids(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Tokens with ``id``; unknown ones are an error.  The vocabulary (a few hundred rows) is broadcast."""
    table = vocabulary.table(tokens.sparkSession).where("vocab_idx = 0").select("token", F.col("id").alias("known"))
    return tokens.join(F.broadcast(table), "token", "left").withColumn("id", _known("token", "known")).drop("known")


def to_tokens(ids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Ids with ``token``; unknown ones are an error."""
    table = vocabulary.table(ids.sparkSession).where("vocab_idx = 0").select("id", F.col("token").alias("known"))
    return ids.join(F.broadcast(table), "id", "left").withColumn("token", _known("id", "known")).drop("known")


def compound_to_ids(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Compound tokens as (score_id, seq_idx, pos, vocab_idx, token, id)."""
    table = vocabulary.table(rows.sparkSession).select("vocab_idx", "token", F.col("id").alias("known"))
    long = rows.select("score_id", "seq_idx", "pos", F.posexplode("tokens").alias("vocab_idx", "token"))
    return long.join(F.broadcast(table), ["vocab_idx", "token"], "left").select("score_id", "seq_idx", "pos", "vocab_idx", "token", _known("token", "known").alias("id"))


def compound_to_tokens(ids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The inverse of :func:`compound_to_ids`: one row of tokens per place."""
    table = vocabulary.table(ids.sparkSession).select("vocab_idx", "id", F.col("token").alias("known"))
    long = ids.drop("token").join(F.broadcast(table), ["vocab_idx", "id"], "left").withColumn("token", _known("id", "known"))
    parts = F.array_sort(F.collect_list(F.struct("vocab_idx", "token")))
    return long.groupBy("score_id", "seq_idx", "pos").agg(F.transform(parts, lambda p: p.token).alias("tokens"))


def to_bytes(ids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(score_id, seq_idx, bytes): one character per id, in order."""
    table = vocabulary.table(ids.sparkSession).where("vocab_idx = 0").select("id", "byte")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "byte")))
    joined = ids.join(F.broadcast(table), "id").groupBy("score_id", "seq_idx").agg(ordered.alias("b"))
    return joined.select("score_id", "seq_idx", F.array_join(F.transform("b", lambda x: x.byte), "").alias("bytes"))


def from_bytes(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(score_id, seq_idx, pos, token) of sequences written by :func:`to_bytes`."""
    table = vocabulary.table(rows.sparkSession).where("vocab_idx = 0").select("byte", F.col("token").alias("known"))
    long = rows.select("score_id", "seq_idx", F.posexplode(F.filter(F.split("bytes", ""), lambda x: x != "")).alias("pos", "byte"))
    found = long.join(F.broadcast(table), "byte", "left")
    return found.select("score_id", "seq_idx", F.col("pos").cast("long").alias("pos"), _known("byte", "known").alias("token"))


def types_in(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(vocab_idx, type, ids): the ids of every token type."""
    return vocabulary.table(spark).groupBy("vocab_idx", "type").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def type_counts(ids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(score_id, type, n_ids, n_used, n_tokens): of every type of the vocabulary its ids, those that a score uses, and how often.

    ``ids`` has score_id and id; the vocabulary (a few hundred rows) is broadcast.
    """
    types = vocabulary.table(ids.sparkSession).where("vocab_idx = 0").select("id", "type")
    sizes = types.groupBy("type").agg(F.count("*").alias("n_ids"))
    known = ids.join(F.broadcast(types), "id").groupBy("score_id", "type").agg(F.countDistinct("id").alias("n_used"), F.count("*").alias("n_tokens"))
    return known.join(F.broadcast(sizes), "type").select("score_id", "type", "n_ids", "n_used", "n_tokens")


def sliced(tokens: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Places ``start`` up to ``end`` (exclusive; to the end without one), numbered from 0."""
    kept = tokens.where((F.col("pos") >= start) & (F.lit(True) if end is None else F.col("pos") < end))
    return kept.withColumn("pos", F.col("pos") - start)


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """The sequences of ``second`` after those of ``first`` with the same score and stream."""
    keys = ["score_id", "seq_idx"]
    size = first.groupBy(*keys).agg((F.max("pos") + 1).alias("size"))
    moved = second.join(size, keys, "left").withColumn("pos", F.col("pos") + F.coalesce("size", F.lit(0))).drop("size")
    return first.unionByName(moved.select(*first.columns))


def split_at_ticks(tokens: DataFrame, ticks: DataFrame, *within: str) -> DataFrame:
    """Tokens with ``part``: how many of the ticks (score_id, n, tick) after the first lie at or before a token's own.

    Tokens before the second tick are part 0.  Ticks never fall along a stream (or along what the
    columns ``within`` tell apart in it), so the parts are ranges of places.
    """
    rows = as_of(tokens, ticks.select("score_id", F.col("tick").alias("start"), F.col("n").alias("reached")), ["score_id"], "tick", "start", ["reached"])
    w = Window.partitionBy("score_id", "seq_idx", *within).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.max(F.greatest(F.coalesce("reached", F.lit(0)), F.lit(0))).over(w)).drop("reached")


def split_tracks(tokens: DataFrame, keep_markers: bool = True) -> DataFrame:
    """A concatenated sequence as one stream per track, cut before every ``Track_Start``."""
    w = Window.partitionBy("score_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("seq_idx", F.greatest(F.sum(F.when(F.col("token") == "Track_Start", 1).otherwise(0)).over(w) - 1, F.lit(0)).cast("int"))
    if not keep_markers:
        rows = rows.where(~F.col("token").isin("Track_Start", "Track_End"))
    own = Window.partitionBy("score_id", "seq_idx").orderBy("pos")
    return rows.withColumn("pos", F.row_number().over(own).cast("long") - 1)


def are_encoded(ids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(score_id, seq_idx, encoded): whether a sequence holds ids beyond the base vocabulary."""
    return ids.groupBy("score_id", "seq_idx").agg((F.max("id") >= vocabulary.sizes[0]).alias("encoded"))


def with_type(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("type", token_type(F.col("token")))

