"""Queries of the training-data operators by name; SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.llm import (
    alignment,
    credentials,
    decontaminate,
    embeddings,
    mixing,
    oracles,
    passages,
    quality,
    simhash,
    substrings,
    tokens,
    toxicity,
    urls,
    whitening,
)
from turnout.llm.common import held_out, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op2_embedding_near_duplicates": oracles.EMBEDDINGS,
    "op3_suffix_array_dedup": oracles.SUBSTRINGS,
    "op7_substring_dedup": oracles.PASSAGES,
    "op9_url_filter": oracles.URLS,
    "op10_benchmark_decontamination": oracles.DECONTAMINATION,
    "op12_secret_scan": oracles.SECRETS,
}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op5_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents")).select(
        "doc_id", "fingerprint", "component_id")


@query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(read_table(spark, folder, "documents"),
                                  read_table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query
def op1_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.tokenized(read_table(spark, folder, "documents")).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def _judged(scored: DataFrame, parts: int, which: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(parts, which).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, folder, "labels"))
    return _judged(quality.scored(docs, model), 3, 1, quality.THRESHOLD)


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, folder, "labels"))
    return _judged(toxicity.scored(docs, model), 4, 2, toxicity.THRESHOLD)


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(read_table(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op2_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, folder, "embeddings"))


@query
def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(read_table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.without_repeats(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.components(read_table(spark, folder, "embeddings"))


@query
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.scan(read_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "live")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
              for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(credentials.listed(base), 256).alias("base_sha256"),
                        credentials.listed("spans").alias("spans"))


@query
def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(read_table(spark, folder, "documents"))
