"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, filter_audit, langid, line_dedup, media, merkle, mixing, ngram_join, quality, secrets, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_read(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_read(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_in_two_steps(_read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target"), "taken", "source")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_rows(_read(spark, sf_dir, "documents"), merkle.tampered_text())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_decontaminate, op3_media, op4_secrets, op5_quality, op6_mixing, op7_url_filter, op8_line_dedup, op9_language, op10_ngram_join, op11_bpe, op12_merkle, op13_filter_audit)
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ARCHIVED_PAGES_SQL,
    "op4_secrets": secrets.FIND_SECRETS_SQL,
    "op7_url_filter": url_filter.judge_urls_sql(),
    "op8_line_dedup": line_dedup.LINE_REPORT_SQL,
    "op12_merkle": merkle.manifest_sql(),
    "op13_filter_audit": filter_audit.audit_sql(),
    "op10_ngram_join": ngram_join.COMPONENTS_SQL,
}
