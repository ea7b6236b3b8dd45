"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .minhash import near_duplicates
from .mixing import mix
from .oracles import ORACLE_SQL  # noqa: F401
from .fingerprints import fingerprint_edits
from .packing import near_copies, packed
from .quality import quality_report
from .html_text import main_text
from .licenses import license_scan
from .sharding import SHARDS, place
from .tokens import LIMIT, token_counts
from .urls import judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packed(docs, near=near_copies(docs))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_table(spark, sf_dir, "documents"), [f"shard-{i:03d}" for i in range(SHARDS)], "doc_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(_table(spark, sf_dir, "documents"), Workspace(spark, "mix"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sharding": op3_sharding,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_counts": op5_token_counts,
    "op6_license_scans": op6_license_scans,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filters": op9_url_filters,
    "op10_mixing": op10_mixing,
}
