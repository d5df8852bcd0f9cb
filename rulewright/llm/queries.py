"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontamination, embedding_dedup, minhash_dedup, oracles, packing, periodic_runs, quality_rules, secret_scan, source_divergence, substring_dedup, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.parse_documents(_table(spark, sf_dir, "documents")).drop("spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.document_findings(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)  # by its contract


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged_documents(_table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.document_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def planted_words(doc_id: int | None, text: bytes | None) -> list[bytes]:
    """The words that op12's contract speaks of: of one text in ten (by id), the end repeats a passage; a null id changes nothing."""
    words = periodic_runs.plain_words(doc_id, text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_table(spark, sf_dir, "documents"), planted_words)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_substring_dedup, op3_toxicity, op4_secret_scan, op5_token_counts, op6_best_fit_packing, op7_url_filter, op8_superminhash_dedup, op9_bpe_round_trip, op10_quality_rules, op11_decontamination, op12_periodic_runs, op13_source_divergence)}

#: Scores, token ids and packings have no SQL form; tests hold those operators against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_secret_scan": oracles.SECRET_SCAN,
    "op7_url_filter": oracles.URL_FILTER,
    "op8_superminhash_dedup": oracles.NEAR_DEDUP,
    "op10_quality_rules": oracles.QUALITY_RULES,
    "op11_decontamination": oracles.DECONTAMINATION,
    "op12_periodic_runs": oracles.PERIODIC_RUNS,
    "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}
