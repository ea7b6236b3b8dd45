"""Search restricted to documents of one chunk family (PDF by default)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import path_prefix, query_phrases
from tessera.operators import dense, fusion, lexical, navigation
from tessera.settings import Settings


def document_search(
    docs: DataFrame, chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], k: int | None = None, mode: str = "hybrid", prefix: str | None = None, family: str = "pdf_", settings: Settings | None = None, postfilter: bool = False, index: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(id, score, sources) of the best chunks of the family: vectors (modes hybrid, semantic), words (hybrid, keyword) and paths or titles (hybrid).

    The scope holds before vectors are cut to the candidates; postfilter instead cuts first, to a multiple of them, and filters then. index: postings and statistics
    of the chunks, without which all are tokenised.
    """
    s = settings or Settings()
    k = s.top_k(k)
    n = min(max(s.candidate_k, s.pdf_dense_multiplier * k), 4000)
    scope = F.startswith("chunk_type", F.lit(family)) & path_prefix(F.col("path"), prefix)
    lists: dict[str, DataFrame] = {}
    if mode in ("hybrid", "semantic"):
        own = chunks.where(scope).select(F.col("id").alias("chunk_id"))
        if postfilter:
            hits = dense.dense_topk(vectors, query_vector, n * s.pdf_dense_multiplier, "chunk_id", "vector").join(own, "chunk_id", "left_semi").orderBy(F.col("score").desc(), "chunk_id").limit(n)
        else:
            hits = dense.dense_topk(vectors.join(own, "chunk_id", "left_semi"), query_vector, n, "chunk_id", "vector")
        lists["dense"] = hits.withColumnRenamed("chunk_id", "id")
    if mode in ("hybrid", "keyword"):
        weights, phrases = {c: w for c, w in navigation.CHUNK_WEIGHTS.items() if index or c in chunks.columns}, query_phrases(query)
        words = lexical.bm25_from_postings(*index, "id", phrases, weights, chunks.where(scope)) if index else lexical.bm25(chunks, "id", weights, phrases, scope)
        lists["fts"] = lexical.top(words, "id", n)
    if mode == "hybrid":
        paths = navigation.document_path_search(docs, chunks, query, n).where(path_prefix(F.col("path"), prefix))
        lists["path"] = navigation.chunks_for_docs(chunks.where(scope), paths.select("doc_id", (1.0 / (1 + F.length("path"))).alias("score")))
    return fusion.fuse(lists, {"dense": s.dense_weight, "fts": s.fts_weight, "path": s.path_weight}, "id", k, s.rrf_k)
