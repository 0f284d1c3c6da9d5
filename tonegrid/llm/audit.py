"""How filters interact: an audit by inclusion-exclusion.

For every subset S of the filters the documents that fail all of S are counted, as sums of
products of their flags.  These joint counts are additive, so partial sums per task are all that
is shuffled.  Everything else is a Möbius inversion of them, a few dozen numbers a part: documents that
survive any set of filters, those that fail one filter only, and the share of each filter in what all
remove together.  The dividend of a set S in that game is (-1)^(|S|+1) times its joint count, and
Shapley values are sums of dividends over |S|.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot_limit, joined
from .storage import checkpointed

LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, MARKS = 100, 80, 10, "[#$%&*|]"
FILTERS = ("A", "B", "C", "D", "E")
#: All orders of so many filters are listed; more would make reports that nobody reads.
MOST_FILTERS = 7


def flag_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part and the flags A to E (1: fails, else 0) of every row of ``docs``.

    A: under 100 words; B: under 80 % of the words are different; C: over 10 % of the code points are A-Z;
    D: holds one of ``#$%&*|``; E: the text equals that of a smaller id.  Null texts count as empty, null parts as
    the empty string.  A null id is smaller than none and none is smaller than it; rows that repeat an id
    and text are no copies of each other.  An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split("body", "[\\x20\\x09-\\x0D]+"), "")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.alias("body"))
    own = own.select("*", words.alias("words")).select("*", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("different"))
    flags = {
        "A": F.col("n") < LEAST_WORDS,
        "B": 100 * F.col("different") < DISTINCT_SHARE * F.col("n"),
        "C": 100 * F.length(F.regexp_replace("body", "[^A-Z]+", "")).cast("long") > CAPITAL_SHARE * F.length("body"),
        "D": F.col("body").rlike(MARKS),
    }
    rows = checkpointed(own.select("doc_id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), *(c.cast("long").alias(k) for k, c in flags.items())))
    classes = checkpointed(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")))
    # One text may be that of a third of all rows; how many rows have it is known.
    found = joined(rows, classes, "digest", "members", hot_limit(classes.agg(F.sum("members")).first()[0] or 0))
    return found.select("doc_id", "part", *flags, F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("long").alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame, marks: dict[str, Column], doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with a column of 1 or 0 for each of ``marks``, conditions on ``labels``: whether any label row of the id meets it.

    Rows without a label, and those of null ids, get 0.
    """
    own = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("marked_id")).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, c in marks.items()))
    # Null ids never match and would gather in one task of the join.
    known = rows.where(F.col(doc_id).isNotNull()).join(own, F.col(doc_id) == F.col("marked_id"), "left").drop("marked_id")
    known = known.withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in marks})
    return known.unionByName(rows.where(F.col(doc_id).isNull()).withColumns({k: F.lit(0).cast("long") for k in marks}))


def joint_failures(rows: DataFrame, filters: tuple[str, ...], weights: tuple[str, ...] = (), part: str = "part") -> DataFrame:
    """One row per part: ``all`` and each of ``weights`` as an array of 2^n sums, entry S over the rows that fail all filters in the bits of S."""
    subsets = range(1 << len(filters))
    flags = lambda s: [f"`{f}`" for i, f in enumerate(filters) if s >> i & 1]
    total = lambda k, s: " * ".join([f"`{k}`" if k != "all" else "1L", *flags(s)])
    names = ("all", *weights)
    sums = rows.groupBy(part).agg(*(F.expr(f"sum({total(k, s)}) AS `{k}_{s}`") for k in names for s in subsets))
    return sums.select(part, *(F.expr(f"array({', '.join(f'`{k}_{s}`' for s in subsets)}) AS `{k}`") for k in names))


def survivors(joint: str, n: int) -> Column:
    """Array of 2^n sums over the rows that fail no filter in the bits of its index: the Möbius inversion of joint failures."""
    signs = F.array(*(F.lit((-1) ** s.bit_count()) for s in range(1 << n)))
    subsets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    term = lambda s, p: F.when(s.bitwiseAND(p) == s, F.get(signs, s) * F.get(F.col(joint), s)).otherwise(F.lit(0).cast("long"))
    return F.transform(subsets, lambda p: F.aggregate(subsets, F.lit(0).cast("long"), lambda total, s: total + term(s, p)))


def shapley(joint: str, n: int) -> Column:
    """Array of n: what each filter removes, summed over all n! orders, from the dividends of the joint failures."""
    dividend = lambda s: f"{(-1) ** (s.bit_count() + 1) * (factorial(n) // s.bit_count())}L * `{joint}`[{s}]"
    return F.expr(f"array({', '.join(' + '.join(dividend(s) for s in range(1 << n) if s >> i & 1) for i in range(n))})")


def audit(rows: DataFrame, filters: tuple[str, ...] = FILTERS, part: str = "part", marks: tuple[str, ...] = ()) -> DataFrame:
    """A report of every order of ``filters`` on every part of ``rows``, one row per step.

    ``rows`` has a long column of 1 (fails) or 0 for each filter, ``part``, and for each of ``marks`` a column of 1 or 0.
    Columns: part, filter_order, step, kept (after this step), removed (here), redundant (failing this
    filter, removed earlier), unique_fails (failing this filter only), ``<mark>_lost`` (removed here and marked), shapley
    (removed by this filter, summed over all orders).  A part has n! times n rows, zeros included; no rows give
    no report.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters are asked for")
    joint = joint_failures(rows, filters, marks, part)
    left = joint.select(part, "all", survivors("all", n).alias("kept_by"), shapley("all", n).alias("values"), *(survivors(m, n).alias(f"{m}_by") for m in marks))
    orders = F.split(F.lit(",".join("".join(map(str, o)) for o in permutations(range(n)))), ",")
    numbers = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.substring("digits", k, F.lit(1)).cast("int"))
    steps = left.select("*", F.explode(orders).alias("digits")).select("*", numbers.alias("order")).select("*", F.posexplode("order").alias("k", "filter"))
    bits, names = F.array(*(F.lit(1 << i) for i in range(n))), F.array(*map(F.lit, filters))
    mask = F.aggregate(F.slice("order", F.lit(1), F.col("k")), F.lit(0), lambda m, i: m + F.get(bits, i))
    steps = steps.select("*", mask.alias("before"), F.get(bits, F.col("filter")).alias("bit"))
    before, bit, everything = F.col("before"), F.col("bit"), F.lit((1 << n) - 1)
    removed = lambda by: F.get(F.col(by), before) - F.get(F.col(by), before + bit)
    return steps.select(
        part,
        F.array_join(F.transform("order", lambda i: F.get(names, i)), "").alias("filter_order"),
        (F.col("k") + 1).alias("step"),
        F.get("kept_by", before + bit).alias("kept"),
        removed("kept_by").alias("removed"),
        (F.get("all", bit) - removed("kept_by")).alias("redundant"),
        (F.get("kept_by", everything - bit) - F.get("kept_by", everything)).alias("unique_fails"),
        *(removed(f"{m}_by").alias(f"{m}_lost") for m in marks),
        F.get("values", F.col("filter")).alias("shapley"),
    )
