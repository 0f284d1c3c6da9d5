"""Whole sequences: what is missing in them, how long they are and whether two are equal.

A sequence is its rows (score_id, seq_idx, pos) with any of the attributes ``id``, ``token``,
``byte`` and ``event`` (a struct of type and value).  It has an attribute if a row of it does; all
here is grouped by sequence and place, so that no sequence gathers in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import token
from ..vocabulary import Vocabulary

SEQ = ["score_id", "seq_idx"]
ATTRIBUTES = ("id", "token", "byte", "event")


def _of(rows: DataFrame, attribute: str, kind: str) -> Column:
    return F.col(attribute) if attribute in rows.columns else F.lit(None).cast(kind)


def completed(rows: DataFrame, vocabulary: Vocabulary, trained: bool = False) -> DataFrame:
    """Tokens from events, else ids, else bytes; then ids from tokens; then, if trained, bytes from ids.

    What is there stays.  A token, id or byte outside the vocabulary (a few hundred rows, broadcast)
    leaves null.
    """
    table = vocabulary.table(rows.sparkSession).where("vocab_idx = 0")
    other = [c for c in rows.columns if c not in ATTRIBUTES]
    event = _of(rows, "event", "struct<type:string,value:string>")
    rows = rows.select(*other, _of(rows, "id", "int").alias("id"), _of(rows, "token", "string").alias("token"), _of(rows, "byte", "string").alias("byte"), event.alias("event"))
    by_id = table.select(F.col("id").alias("at_id"), F.col("token").alias("of_id"))
    by_byte = table.select(F.col("byte").alias("at_byte"), F.col("token").alias("of_byte"))
    by_token = table.select(F.col("token").alias("at_token"), F.col("id").alias("id_of"), F.col("byte").alias("byte_of"))
    out = rows.join(F.broadcast(by_id), F.col("id") == F.col("at_id"), "left").join(F.broadcast(by_byte), F.col("byte") == F.col("at_byte"), "left")
    out = out.withColumn("token", F.coalesce("token", token(F.col("event.type"), F.col("event.value")), "of_id", "of_byte"))
    out = out.join(F.broadcast(by_token), F.col("token") == F.col("at_token"), "left").withColumn("id", F.coalesce("id", "id_of"))
    made = F.coalesce("byte", "byte_of") if trained else F.col("byte")
    return out.select(*other, "id", "token", made.alias("byte"), "event")


def sizes(rows: DataFrame, encoded: bool = False) -> DataFrame:
    """(score_id, seq_idx, size): ids if they are ``encoded``, else tokens, events or bytes, the first that a sequence has."""
    order = [*(["id"] if encoded else []), "token", "event", "byte"]
    counts = [F.when(F.count(a) > 0, F.count(a)) for a in order if a in rows.columns]
    return rows.groupBy(*SEQ).agg(F.coalesce(*counts, F.lit(0)).cast("long").alias("size"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(score_id, seq_idx, equal): whether every attribute that both sequences have is the same, and there is one."""
    shared = [x for x in ATTRIBUTES if x in a.columns and x in b.columns]
    side = lambda df, name: df.select(*SEQ, "pos", F.struct(*shared).alias(name))
    pairs = side(a, "a").join(side(b, "b"), [*SEQ, "pos"], "full")
    has = lambda name, x: F.max(F.col(f"{name}.{x}").isNotNull())
    both = [has("a", x) & has("b", x) for x in shared]
    same = [F.bool_and(F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}"))) for x in shared]
    checks = [F.when(both[i], same[i]) for i in range(len(shared))]
    found = F.array_compact(F.array(*checks))
    return pairs.groupBy(*SEQ).agg(found.alias("found")).select(*SEQ, ((F.size("found") > 0) & F.forall("found", lambda x: x)).alias("equal"))
