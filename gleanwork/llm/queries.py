"""The registered query of each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import alignment, bpe, compression_quality, fingerprints, lm_scoring, mixing, near_dedup, nearest, quality_rules, secret_scan, snapshot_diff, token_files, warc
from gleanwork.llm._shared import documents, materialise, word_count
from gleanwork.llm.oracles import ORACLES


TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(materialise(docs, "mix-sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = docs.withColumn("held_out", compression_quality.held_out())
    return compression_quality.score_quality(docs, model)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op4_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    manifest = token_files.write_token_files(docs, path or public_tokenizers.path(TOKENIZER), end_id=2)
    return token_files.read_token_files(spark, manifest)


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_documents(docs, path or public_tokenizers.path(TOKENIZER))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(documents(spark, sf_dir).select("doc_id", "text"), good)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("source").alias("host"), "text")
    verdict = quality_rules.judge_quality(docs)
    return verdict.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "lost_words")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_warc(pages)
    return warc.read_warc(spark, manifest, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op12_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return snapshot_diff.diff_snapshots(docs, snapshot_diff.later_snapshot(docs), "doc_id", ["text", "lang", "source"])


def op13_alignment(spark: SparkSession, sf_dir: str, path: str | None = None, pieces: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return alignment.align_tokenizers(docs, path or public_tokenizers.path(TOKENIZER), pieces or public_tokenizers.path(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mix_sources, op2_compression_quality, op3_fingerprints, op4_token_files, op5_bpe, op6_lm_scoring, op7_near_duplicates, op8_quality_rules, op9_secret_scan, op10_warc, op11_nearest, op12_snapshot_diff, op13_alignment]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
