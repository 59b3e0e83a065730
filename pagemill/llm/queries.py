"""Queries of this subpackage: name -> function of (spark, directory of the tables), and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fillmiddle, jaccard, licenses, lmscore, mixing, multiset, quality, secrets, sql, tokencount, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(table(spark, sf_dir, "documents"))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op7_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs)


def op9_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs)


def op11_event_scan_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fillmiddle.fill_in_middle(table(spark, sf_dir, "documents"))

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    back = fillmiddle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op12_two_pass_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited(table(spark, sf_dir, "documents"))


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("at").alias("captured_at"))


def op2_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op3_minhash_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = secrets.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    rows = rows.withColumn("found", found)

    def count(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_digest(F.col("found"), True).cast("binary"), 256).alias("base_sha256"),
        secrets.span_digest(F.col("found"), False).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index_merge": op1_warc_index_merge,
    "op2_heavy_light_jaccard": op2_heavy_light_jaccard,
    "op3_minhash_licenses": op3_minhash_licenses,
    "op4_blob_ledger_secrets": op4_blob_ledger_secrets,
    "op5_attention_scores": op5_attention_scores,
    "op6_trie_token_counts": op6_trie_token_counts,
    "op7_boosted_toxicity": op7_boosted_toxicity,
    "op8_compression_quality": op8_compression_quality,
    "op9_qgram_decontamination": op9_qgram_decontamination,
    "op10_systematic_mix": op10_systematic_mix,
    "op11_event_scan_fim": op11_event_scan_fim,
    "op12_two_pass_whitening": op12_two_pass_whitening,
    "op13_multiset_fingerprints": op13_multiset_fingerprints,
}

SQL: dict[str, str] = {
    "op1_warc_index_merge": sql.OP1,
    "op4_blob_ledger_secrets": sql.OP4,
    "op10_systematic_mix": sql.OP10,
    "op11_event_scan_fim": sql.OP11,
}
