from __future__ import annotations

import random

import numpy as np
import zlib

import corpus_pipeline
from tonegrid.llm import decontamination, packing, quality, secrets
from tonegrid.llm.queries import tokenizer_path


def test_run_does_what_the_stages_do(spark, tmp_path):
    rng = random.Random(9)
    words = [f"tok{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(20, 80))) for i in range(240)]
    rows = [(i, t.replace(" ", "### ") if i % 6 == 0 else t) for i, t in rows]
    leak = " ".join(f"secretitem{i}" for i in range(12))
    rows += [(300, rows[1][1]), (301, rows[1][1]), (302, text(20) + " " + leak + " " + text(10)), (303, text(25) + " password=abcdefgh1234"), (304, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i, _ in rows[:240]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert not kept & {300, 301, 302} and {1, 303} <= kept
    assert not {i for i in range(0, 240, 6)} & kept and len({i for i in range(240) if i % 6} & kept) >= 190
    encode = packing.encoder_of(tokenizer_path()).encode
    by_id = dict(rows)
    clean = secrets.redacted(by_id[303], [("assign", *secrets.RULES[0].compiled().search(by_id[303]).span())], "[secret]")
    ids = np.append(np.frombuffer(encode(clean), "<u4"), 1).astype("<u4")
    assert next(r for r in out if r.doc_id == 303).ids_crc32 == zlib.crc32(ids.tobytes())


def test_every_stage_but_the_last_keeps_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, 7)], "doc_id long, text string, lang string, source string, n_chars long, fp int")
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    model = quality.fit([("good text", 1), ("###", 0)] * 4, epochs=1)
    for out in (quality.keep_good(docs, model), decontamination.decontaminate(docs, items), secrets.redact_secrets(docs)):
        assert out.columns == docs.columns and out.schema["n_chars"] == docs.schema["n_chars"]
    assert len(corpus_pipeline.STAGES) == 5
