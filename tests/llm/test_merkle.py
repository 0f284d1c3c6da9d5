"""The manifest against trees built level by level in Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tonegrid.llm import merkle
from tonegrid.llm.queries import queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """The root, and each leaf's (siblings before, after) level by level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    ways = []
    for i in range(len(digests)):
        way = []
        for level in levels[:-1]:
            run = i // 3 * 3
            way.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            i //= 3
        ways.append(way)
    return levels[-1][0], ways


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in order}
    root, ways = tree([trees[s][0] for s in order])
    out = []
    for s, upper in zip(order, ways, strict=True):
        subroot, own = trees[s]
        for r, way in zip(by[s], own, strict=True):
            path, d, new = way + upper, leaf(r), r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                new = (*r[:4], r[4].replace("\n", ""))
            d = leaf(new)
            for before, after in path:
                d = H(before, d, after)
            out.append((r[0], leaf(r), subroot, root, H(*(b + a for b, a in path)), d, d == root))
    return out


def tables():
    rows = [(i, "hot", "en", i, f"text {i}\nline" if i % 3 else f"text {i}") for i in range(2300)]
    rows += [(i, f"s{i % 13}é", None, None, None if i % 5 == 0 else "é\n\n") for i in range(3000, 3040)]
    rows += [(1, None, "de", 0, ""), (1, None, "de", 0, ""), (None, None, None, None, None), (None, "hot", "x", 1, "\n"), (7, "", "en", 1, "a"), (5000, "alone", "en", 9, "long \n" * 100_000)]
    return rows


def test_the_query(spark, tmp_path):
    rows = tables()
    extra = [(*r, "x", 1) for r in rows]
    spark.createDataFrame(extra, "doc_id long, source string, lang string, n_chars long, text string, tree string, path int").select("text", "path", "n_chars", "source", "tree", "lang", "doc_id").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op12_merkle"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    own = expected(rows)
    assert Counter(map(tuple, found.collect())) == Counter(own)
    assert 100 < sum(not r[-1] for r in own) < len(own) - 100


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3], [4, 1], [729], [730, 2, 27], [28, 0, 9, 10]])
def test_sizes_around_full_levels(spark, sizes):
    rows = [(i, f"g{k}", "", 0, "") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(docs, FIELDS)
    own = {(r[0], r[1]): r[2:4] for r in expected(rows)}
    assert {(r.doc_id, r.leaf): (r.subroot, r.root) for r in found.collect()} == own
    assert found.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == len(rows)


def test_parents_sent_on_early_and_in_any_order(monkeypatch):
    digests = [H(str(i)) for i in range(1000)]
    out, frontier = [], []
    for part in range(7):
        own = merkle.Partial()
        for i in range(part, 1000, 7):
            out += own.add("t", 1000, 0, i, digests[i])
            if len(own.parents) > 20:
                frontier += own.rest()
        frontier += own.rest()
    last = merkle.Partial()
    for t, n, level, place, d, _ in reversed(frontier):
        out += last.add(t, n, level, place, d)
    assert not last.parents and [x[4] for x in out if x[5] == merkle.ROOT] == [tree(digests)[0]]


def test_changes_are_found(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(docs, FIELDS, extra={"n": F.col("doc_id")})
    fold = lambda d: merkle.folded(d, F.col("path")) == F.col("root")
    assert found.where(fold(F.col("leaf"))).count() == 40 and found.where(fold(F.sha2(F.lit("x").cast("binary"), 256))).count() == 0
    assert merkle.manifest(docs.where("false"), FIELDS).count() == 0
