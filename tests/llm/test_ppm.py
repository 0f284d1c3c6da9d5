"""Prediction by partial matching and the word model against walking text and trie symbol by symbol."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import ppm
from tonegrid.llm.queries import queries


def symbols(text, order):
    return [ppm.START] * order + list((text or "").encode()) + [ppm.END]


class Slow:
    """A trie of nested counters."""

    def __init__(self, texts, order, share):
        self.order, counts = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            s = symbols(t, order)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[k][tuple(s[i - k : i])][s[i]] += 1
        least = share * sum(counts[0][()].values())
        self.total = [{c: sum(n.values()) for c, n in level.items()} for level in counts]
        self.kept = [{c: own for c, n in level.items() if (own := {x: m for x, m in n.items() if m >= least})} for level in counts]

    def chances(self, context):
        """Probability of every symbol after a context, as steps down the trie."""
        out, left, excluded = {}, 1.0, set()
        for k in range(self.order, -1, -1):
            c = tuple(context[len(context) - k :])
            if c not in self.kept[k]:
                continue
            own = {x: n for x, n in self.kept[k][c].items() if x not in excluded}
            total = self.total[k][c] - sum(n for x, n in self.kept[k][c].items() if x in excluded)
            if total + len(own) == 0:
                continue
            for x, n in own.items():
                out[x] = left * n / (total + len(own))
            left *= (total - sum(own.values()) + len(own)) / (total + len(own))
            excluded |= set(self.kept[k][c])
        for x in range(ppm.SYMBOLS):
            if x not in excluded:
                out[x] = left / (ppm.SYMBOLS - len(excluded))
        return out

    def log_probability(self, text):
        s = symbols(text, self.order)
        return sum(math.log10(self.chances(s[:i])[s[i]]) for i in range(self.order, len(s)))


def corpus():
    rng = random.Random(5)
    syllables = ["ba", "ke", "lo", "Mi", "nu", "ré", "so"]
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(rng.randint(1, 40))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (101, ""), (102, " \n\x0b "), (None, "ba ke"), (None, None), (103, rows[3][1]), (104, rows[3][1]), (105, "zz " * 300 + "\x1c　\U0001f600 Q"), (3, rows[3][1])]


def training(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 != 0


def test_the_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_COUNTS", 50)
    rows = corpus()
    extra = [(i, t, "en", 1.0, 2) for i, t in rows]
    spark.createDataFrame(extra, "doc_id long, text string, word string, score double, gram int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op13_ppm"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    tokens = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]
    count = Counter(w for i, t in rows if training(i) for w in tokens(t))
    n = count.total()
    slow = Slow([t for i, t in rows if training(i)], ppm.ORDER, ppm.LEAST_SHARE)
    own = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (len(count) + 1))) for x in w)
        own.append((i, not training(i), len(w), sum(x in count for x in w), n, round(base, 6), round(slow.log_probability(t), 6)))
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, found.collect())) == Counter(own)
    assert any(r[1] for r in own)


@pytest.mark.parametrize(("order", "share"), [(1, 0.0), (2, 0.01), (3, 0.003), (6, 0.002)])
def test_orders_and_shares(spark, order, share):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 4 == 0
    model = ppm.train(docs, held, order=order, least_share=share, frequent_share=0.02)
    assert 0 < len(model.frequent) <= 50
    slow = Slow([t for i, t in rows if i is None or i % 4], order, share)
    texts = [t for _, t in rows]
    assert np.allclose(model.trie.log_probability(texts), [slow.log_probability(t) for t in texts], atol=1e-9)
    if share:
        assert max(len(x.grams) for x in model.trie.levels) <= 1 / share
    found = {(r.doc_id, r.text): (r.n_known, round(r.base_score, 9)) for r in ppm.score(docs, model).collect()}
    plain = {(r.doc_id, r.text): (r.n_known, round(r.base_score, 9)) for r in ppm.score(docs, ppm.train(docs, held, order=1, frequent_share=2.0)).collect()}
    assert found == plain


def test_chances_sum_up_to_one():
    slow = Slow([t for _, t in corpus()], 2, 0.004)
    for context in ([ppm.START, ppm.START], list(b"ba"), list(b"e "), list(b"??")):
        assert abs(sum(slow.chances(context).values()) - 1) < 1e-12


def test_no_training_texts(spark):
    docs = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    model = ppm.train(docs, F.lit(True))
    rows = {r.doc_id: r for r in ppm.score(docs, model).collect()}
    assert abs(rows[1].score + 5 * math.log10(257)) < 1e-9 and rows[1].base_score == 0 and rows[1].n_known == 0 and rows[2].n_tokens == 1
    assert ppm.score(docs.where("false"), ppm.train(docs.where("false"), F.lit(False))).count() == 0


def test_seen_text_is_likelier_than_noise(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    model = ppm.train(docs, F.lit(False))
    own, noise = model.trie.log_probability([corpus()[3][1], "".join(random.Random(1).choices("bcdfghjkQXW#~", k=len(corpus()[3][1])))])
    assert own > noise / 2


def test_pieces_of_long_texts():
    texts = [t for _, t in corpus()]
    whole = [x for keys, _, _ in ppm.pieces(texts, 3) for x in keys.tolist()]
    assert len(whole) == sum(len((t or "").encode()) + 1 for t in texts)
    for most in (1, 2, 7, 50):
        cut = list(ppm.pieces(texts, 3, most))
        assert [x for keys, _, _ in cut for x in keys.tolist()] == whole and max(len(keys) for keys, _, _ in cut) < 2 * most
        sizes = Counter()
        for keys, starts, numbers in cut:
            for n, a, b in zip(numbers.tolist(), starts.tolist(), [*starts.tolist()[1:], len(keys)], strict=True):
                sizes[n] += b - a
        assert sizes == {n: len((t or "").encode()) + 1 for n, t in enumerate(texts)}


def test_rare_contexts_of_many_symbols_are_kept(spark):
    """Contexts that occur once among more than 2^19 symbols, scored in tasks."""
    rows = [*((i, "ab" * 140_000) for i in range(2)), (2, "xyzzy xyz"), (3, "xyzzyx \x1c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    slow = Slow([t for i, t in rows if i < 3], 2, 0.0)
    assert slow.total[0][()] > 2**19
    found = {r.doc_id: r.score for r in ppm.score(docs, ppm.train(docs, F.col("doc_id") == 3, order=2)).collect()}
    assert np.allclose([found[2], found[3]], [slow.log_probability(t) for _, t in rows[2:]], atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 6])
def test_groups_of_contexts(spark, monkeypatch, order):
    monkeypatch.setattr(ppm, "GROUP_GRAMS", 3)
    rows = corpus()
    model = ppm.train(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 == 0, order=order)
    assert len(model.trie.present) > 4 and model.trie.groups > len(model.trie.present)
    slow, texts = Slow([t for i, t in rows if i is None or i % 4], order, 0.0), [t for _, t in rows]
    assert np.allclose(model.trie.log_probability(texts), [slow.log_probability(t) for t in texts], atol=1e-9)
