"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm import decontam, licences, lines, manifest, mixing, multi_index, ngram_join, pii, quality, secrets, sharding, spelling, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents"), key=b"surrogate key of this corpus").select("doc_id", "text", "n_entities")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op5_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), chance=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row proven; where 5 divides the id's crc32, what is tested is a text that was lower-cased."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.manifest(_table(spark, sf_dir, "documents"), changed={"text": lowered}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), noise=97)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_pii_surrogates, op3_token_counts, op4_licence_scan, op5_repeated_lines, op6_secret_scan, op7_ngram_jaccard, op8_source_mix, op9_benchmark_leaks, op10_quality, op11_merkle_manifest, op12_feistel_shards, op13_spelling_variants)}
SQL = {"op5_repeated_lines": lines.SQL, "op8_source_mix": mixing.SQL, "op11_merkle_manifest": manifest.SQL, "op12_feistel_shards": sharding.SQL, "op13_spelling_variants": spelling.SQL}
