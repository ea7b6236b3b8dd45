"""From documents to packed training bins: quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder as Parquet and
reads again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Workspace
from tessera.llm.minhash import drop_near_duplicates
from tessera.llm.mixing import mixed_documents
from tessera.llm.packing import packed
from tessera.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document in a bin; copies of a text never share one."""
    return packed(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_bins", pack_bins)]

#: Signatures, dependent rounding and best fit are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.put(stage(spark, docs, sf_dir), name)
    return docs
