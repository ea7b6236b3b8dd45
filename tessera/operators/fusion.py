"""Weighted reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, id_col: str, source: str, order: int) -> DataFrame:
    """A candidate list (id, score), already cut to its best, with 1-based ranks; ties by id. The window spans that list only."""
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(id_col)))
    return scored.select(F.col(id_col), F.lit(source).alias("source"), F.lit(order).alias("source_order"), F.col("score").cast("double").alias("raw"), rank.alias("rank"))


def fuse(lists: dict[str, DataFrame], weights: dict[str, float], id_col: str, k: int, rrf_k: int = 60, bonus: dict[str, float] | None = None) -> DataFrame:
    """The k best ids by sum of weight / (rrf_k + rank), plus bonus * max(0, raw score) for the sources in `bonus`.

    Equal scores are ordered by the source that named an id first (in the order of `lists`), its rank there, and the id.
    """
    bonus = bonus or {}
    every = reduce(DataFrame.unionByName, (ranked(df, id_col, name, i) for i, (name, df) in enumerate(lists.items())))
    term = F.lit(0.0)
    for name in lists:
        own = F.lit(weights[name]) / (rrf_k + F.col("rank")) + F.lit(bonus.get(name, 0.0)) * F.greatest(F.lit(0.0), F.col("raw"))
        term = F.when(F.col("source") == name, own).otherwise(term)
    fused = every.groupBy(id_col).agg(F.sum(term).alias("score"), F.min(F.struct("source_order", "rank")).alias("first"), F.array_sort(F.collect_list("source")).alias("sources"))
    return fused.orderBy(F.col("score").desc(), "first", F.col(id_col)).limit(k).select(id_col, "score", "sources")
