"""The operators of this subpackage, each applied to its whole table in ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontamination, licenses, merkle, neighbours, packing, ppm, quality, secrets, sharding, simhash, toxicity, urlfilter
from .sampling import held_out

#: Rules (host and path, verdict) of the url query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    n_hit = decontamination.hit_words("spans")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=4, fold=2)
    scored = toxicity.score_toxicity(docs, model, threshold=0.3)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_toxic_sentences"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [i for i, t in enumerate(licenses.TEMPLATES) if t.base]
    names = F.array(*(F.lit(t.label) for t in licenses.TEMPLATES))
    places = F.filter("matches", lambda m: m.template.isin(base))
    return found.withColumn("base", places).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda m: F.get(names, m.template)))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(secrets.span_list("secrets", base).cast("binary"), 256).alias("base_sha256"), secrets.span_list("secrets").alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), folds=5, fold=0)
    return quality.score_quality(docs, model, threshold=0.3).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = audit.flag_texts(table(spark, sf_dir, "documents"))
    marked = audit.with_labels(flagged, table(spark, sf_dir, "labels"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit.audit(marked, marks=("good", "toxic"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    cut = [F.col(f) for f in fields[:-1]] + [F.replace(F.col("text"), F.lit("\n"), F.lit(""))]
    found = merkle.manifest(table(spark, sf_dir, "documents"), fields, extra={"tampered": F.when(even & F.col("text").contains("\n"), merkle.leaf_digest(cut))})
    refolded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), refolded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ppm.train(docs, held_out("doc_id", 10, 0))
    scored = ppm.score(docs, model, columns=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_toxicity, op4_licenses, op5_secrets, op6_packing, op7_quality, op8_urls, op9_sharding, op10_neighbours, op11_filter_audit, op12_merkle, op13_ppm)}
