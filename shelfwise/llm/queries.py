"""The operators applied to whole test tables, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations, decontaminate, lines, mixing, pieces, pii, quality_rules, resampling, secrets, simhash, tokens, toxicity, variants,
)
from .rows import text_or_empty
from .statements import LINES, PHRASES, VARIANTS, WINDOWS

TOKEN_FILE, TOKEN_LIMIT = "byte_bpe_50k.json", 1024
PIECE_FILE = "piece_bpe_32k.model"
#: Phrases listed of each lang.
TOP_PHRASES = 2000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = TOKEN_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), toxicity.score(docs, toxicity.trained(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    found = tokens.counts(spark, text, vocabulary_path(), TOKEN_LIMIT)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), found.alias("found"))
    n = F.col("found.n_tokens")
    return rows.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"), F.col("found.cut").alias("chars_within_limit"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.found(docs, pii.fit(pii.proposals(docs)))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


def op4_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("k_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_boilerplate(_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("new_text").alias("text"), "n_lines", "n_dropped")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words = secrets.dictionary(docs)
    found = secrets.found(docs, secrets.fit(secrets.findings(docs, words=words), words))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_candidates", F.size("spans").cast("bigint").alias("n_secrets"), spans.alias("spans"))


def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.sampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("k_id").alias("doc_id"), "log_weight", "key", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), *quality_rules.STATISTICS, "base_failed", "kept", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.vocabulary(variants.typed(_table(spark, sf_dir, "documents")))
    return variants.grouped(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, ids = vocabulary_path(PIECE_FILE), F.col("ids")
    rows = _table(spark, sf_dir, "documents").select("doc_id", pieces.encoded(spark, F.col("text").cast("string"), model).alias("ids"))
    return rows.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"), pieces.digest(ids).alias("ids_sha256"),
        F.sha2(pieces.decoded(spark, ids, model), 256).alias("decoded_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(_table(spark, sf_dir, "documents"))
    return collocations.ranked(found, TOP_PHRASES).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_token_counts, op3_pii, op4_benchmark_hits, op5_simhash, op6_mixing, op7_boilerplate_lines, op8_secrets,
        op9_resampling, op10_quality_rules, op11_spelling_variants, op12_sentencepiece, op13_collocations,
    )
}

#: The rest has models, hashes or schedules that SQL lacks; their tests compare with brute force or held-out labels.
LLM_ORACLE: dict[str, str] = {
    "op4_benchmark_hits": WINDOWS, "op7_boilerplate_lines": LINES, "op11_spelling_variants": VARIANTS, "op13_collocations": PHRASES,
}
