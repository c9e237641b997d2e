"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, neardup, packing, quality, secrets, sharding, tokencount, urls, warc
from .common import parquet


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.verdicts(parquet(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(parquet(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(parquet(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(parquet(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(parquet(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(parquet(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.verdicts(decontam.find_hits(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(parquet(spark, sf_dir, "documents"), k=3, percent=85)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(parquet(spark, sf_dir, "documents"), tokenizer_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignments(parquet(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scans": secrets.SQL, "op4_quality_rules": quality.SQL, "op5_url_filters": urls.SQL, "op6_license_scans": licenses.SQL}
