"""Registered queries of the subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, chat, license_scan, line_dedup, media, mixing, near_dedup, toxicity, url_filter, va_file


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_read(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op5_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.flag_urls(pages, url_filter.build(url_filter.listed_keys(pages), url_filter.page_keys(pages)))


def op6_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def op7_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return va_file.search(vectors, vectors.filter(f"vec_id % {va_file.EVERY} = 0"))


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_targets(_read(spark, sf_dir, "conversations"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), report=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


OPERATORS = (
    op1_prob_minhash,
    op2_media_columns,
    op3_mix_sources,
    op4_license_scan,
    op5_bloom_cascade,
    op6_bpe_encode,
    op7_va_file,
    op8_prefix_targets,
    op9_line_chunks,
    op10_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op5_bloom_cascade": url_filter.SQL, "op7_va_file": va_file.SQL, "op8_prefix_targets": chat.SQL}
