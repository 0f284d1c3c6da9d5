"""The registered queries on written tables, their contract columns recomputed row by row."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tonegrid.llm import licenses, packing, quality, toxicity
from tonegrid.llm.queries import queries, tokenizer_path

from .test_text_operators import WORD, contaminated, corpus, linked, lower, slow_fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, predicted string"
ITEMS = [(1, " ".join(f"LEAK{i}" for i in range(14))), (2, "short item"), (3, None), (5, "one two")]
PROSE = ["bale", "torin", "meko", "lasta", "vindo", "quer", "sami", "ulto"]


def documents() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    out = list(corpus())
    for i in range(1000, 1240):
        sentences = [" ".join(rng.choice(PROSE) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            sentences[rng.randrange(len(sentences))] += " grobian"
        text = ". ".join(sentences)
        out.append((i, text.replace(" ", "### ") if i % 4 == 0 else text))
    return [*out, (1000, out[-240][1]), (5000, "long word " * 60_000)]


def write(spark, folder, docs, labels, items, vectors, pages):
    rows = [(i, t, "en", "s", len(t or ""), 0.25, 1, "own") for i, t in docs]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], 0) for i in range(250)]
    vectors += [(300, None, 0), (400, [0.0] * 8, 0), (500, [float("nan")] * 8, 0), (600, vectors[3][1], 0)]
    pages = [(1, "https://A.net/x", ""), (1, "https://A.net/x", ""), (2, None, None), (3, "http://example.com/de" + "/y" * 200_000, ""), (None, "x://q.org/fr/#", "")]
    labels = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(1000, 1240)] + [(None, 1, 1), (7777, 0, 1), (1001, 1, 0), (1002, None, None)]
    return write(spark, tmp_path_factory.mktemp("tables"), documents(), labels, ITEMS, vectors, pages)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], [])


def rows_of(spark, folder, name):
    frame = queries()[name](spark, folder)
    return frame.columns, [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


def test_the_pipeline_of_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_op1(spark, tables):
    columns, rows = rows_of(spark, tables, "op1_decontamination")
    assert columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = []
    for i, t in documents():
        n, hit, items = contaminated(t, 10, ITEMS) if i != 5000 else (120_000, 0, [])
        expected.append((i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
    assert Counter(r[:6] for r in rows) == Counter(expected)


def test_op2(spark, tables):
    columns, rows = rows_of(spark, tables, "op2_simhash")
    assert columns[:3] == ["doc_id", "fingerprint", "component_id"]
    docs = documents()
    fps = [slow_fingerprint(t) for _, t in docs]
    assert Counter(r[:3] for r in rows) == Counter(zip([i for i, _ in docs], [f"{f:016x}" for f in fps], linked([i for i, _ in docs], fps), strict=True))


def noisy_or(model: toxicity.NoisyOr, text: str | None) -> float:
    """Sentence by sentence, the chance that at least one is toxic."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", lower(text)):
        found = set(re.findall(r"[^\x00-\x60\x7B-\x7F]+", sentence))
        if found:
            z = model.bias + sum(model.weights.get(w.encode(), 0.0) for w in found)
            clean *= 1 - 1 / (1 + np.exp(-z))
    return 1 - clean


@pytest.mark.parametrize(("name", "column", "folds", "fold"), [("op3_toxicity", 2, 4, 2), ("op7_quality", 1, 5, 0)])
def test_the_classifiers(spark, tables, name, column, folds, fold, monkeypatch):
    fitted = []
    module = toxicity if column == 2 else quality
    fit = module.fit
    monkeypatch.setattr(module, "fit", lambda sample, **more: fitted.append((sample, fit(sample, **more))) or fitted[-1][1])
    columns, rows = rows_of(spark, tables, name)
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    texts = defaultdict(set)
    for i, t in documents():
        texts[i].add(t)
    assert Counter(r[0] for r in rows) == Counter(i for i, _ in documents())
    (sample, model) = fitted[0]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == fold
    allowed = {t for i, t in documents() if i is not None and 1000 <= i < 1240 and not held(i)}
    assert sample and {t for t, _ in sample} <= allowed
    for i, held_out, score, predicted in (r[:4] for r in rows):
        assert held_out == held(i) and 0 <= score <= 1 and predicted == int(score >= 0.3)
        own = [noisy_or(model, t) if column == 2 else model.score(t) for t in texts[i]]
        assert min(abs(score - x) for x in own) < 1e-6
    right = [predicted == (int(i % 4 != 0) if column == 1 else int(i % 5 == 0)) for i, _, _, predicted in (r[:4] for r in rows) if i is not None and 1000 <= i < 1240 and held(i)]
    assert np.mean(right) >= 0.9


def test_op4(spark, tables):
    columns, rows = rows_of(spark, tables, "op4_licenses")
    assert columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    base, expected = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")], []
    for i, t in documents():
        w = WORD.findall(lower(t))
        at = sorted((k, label) for phrase, label in base for k in range(len(w)) if w[k : k + len(p := phrase.split())] == p)
        expected.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert Counter(r[:6] for r in rows) == Counter(expected)
    assert all(set(r[5].split(",")) - {""} <= set(r[6].split(",")) and (r[7] > 0) == bool(r[6]) for r in rows)
    assert {"cc-by-nc", "lgpl", "bsd"} <= {x for r in rows for x in r[6].split(",")} <= {""} | {t.label for t in licenses.TEMPLATES}


def test_op5(spark, tables):
    columns, rows = rows_of(spark, tables, "op5_secrets")
    assert columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    expected = []
    for i, t in documents():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 32]
        spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        expected.append((i, *(sum(k == j for _, k, _ in found) for j in range(3)), hashlib.sha256(spans.encode()).hexdigest()))
    assert Counter(r[:5] for r in rows) == Counter(expected)
    assert any("github" in r[5] for r in rows)


def test_op6(spark, tables):
    columns, rows = rows_of(spark, tables, "op6_packing")
    assert columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    encode = packing.encoder_of(tokenizer_path()).tokenizer.encode
    expected = Counter()
    for i, t in documents():
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            piece = ids[a : a + 2048]
            expected[i, a, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter(r[:5] for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r[5]].append((r[6], r[2]))
    padding = 0
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 2048 - end
    assert padding < 3 * 2048


def test_op8(spark, tables):
    columns, rows = rows_of(spark, tables, "op8_urls")
    assert columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    path = "/de" + "/y" * 200_000
    assert Counter(r[:5] for r in rows) == Counter(
        [(1, "a.net", "/x", "net/", "block"), (1, "a.net", "/x", "net/", "block"), (2, "", "", None, "allow"), (3, "example.com", path, "example.com/de/", "block"), (None, "q.org", "/fr/", "org/fr/", "allow")]
    )


def test_op9(spark, tables):
    columns, rows = rows_of(spark, tables, "op9_sharding")
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    raw = lambda t: (t or "").encode()
    assert Counter(r[:3] for r in rows) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t in documents())
    slots = defaultdict(list)
    for r in rows:
        assert r[3] == "bytes" and 0 <= r[4] < 40 and r[6] is None
        slots[r[4]].append(r[5])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op10(spark, tables):
    columns, rows = rows_of(spark, tables, "op10_neighbours")
    assert columns[:4] == ["query_id", "rank", "vec_id", "score"]
    rng = np.random.default_rng(0)
    x = np.array([rng.normal(size=8).astype(np.float32) for _ in range(250)], float)
    ids, x = np.append(np.arange(250), 600), np.vstack([x, x[3]])
    hit = 0
    for q in (0, 100, 200, 600):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        near = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        own = sorted(r for r in rows if r[0] == q)
        assert [r[1] for r in own] == list(range(1, 11)) and all(abs(r[3] - d[ids == r[2]][0]) < 1e-12 for r in own)
        hit += len({r[2] for r in own} & {int(ids[i]) for i in near})
    assert {r[0] for r in rows} == {0, 100, 200, 600} and hit >= 36
    assert [r[2] for r in sorted(rows) if r[0] == 600 and r[1] == 1] == [3]
