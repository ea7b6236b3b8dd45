"""Exact nearest vectors by inner product, and hash embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot
from tessera.session import shared_folder


#: Scores that a task holds at once, besides the best so far.
SCORES = 2_000_000


def dense_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k rows of greatest inner product with the query, (id, score), ties by id. where: before the cut (a scope applied after it is a filter on the result)."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(F.col(id_col), dot(F.col(vector_col), q).alias("score")).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def _nearest(vectors: DataFrame, asked: list, k: int, id_col: str, vector_col: str, query_id: str) -> tuple[DataFrame, Broadcast]:
    """(query_id, id, score) of the k nearest rows of each query in each task, and the broadcast queries."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in asked]), np.array([r[1] for r in asked], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        step = max(1, SCORES // len(names))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                own = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
                scores = np.concatenate([scores, matrix @ own.T], 1)
                ids = np.concatenate([ids, np.broadcast_to(batch.column(0).to_numpy(), (len(names), len(own)))], 1)
                order = np.lexsort((ids, -scores))[:, :k]
                ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], names=[query_id, id_col, "score"])

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vector_col).mapInArrow(run, f"{query_id} long, {id_col} long, score double"), shared


def in_blocks(queries: DataFrame, query_id: str, schema: str, most_queries: int, search: Callable[[list], tuple[DataFrame, Broadcast]]) -> DataFrame | None:
    """What search gives for the queries (query_id, vector): of all of them at once, or, if they are more than most_queries, of one block after another.

    Blocks are of about most_queries by hash, and what they give is written to the shared folder, so that the driver and the tasks hold one block at a time. None without queries.
    """
    spark, asked = queries.sparkSession, queries.limit(most_queries + 1).collect()
    if len(asked) <= most_queries:
        return search(asked)[0] if asked else None
    root, blocks = shared_folder(spark, "dense"), -(-queries.count() // most_queries)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64(query_id, "vector"), F.lit(blocks)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(f"{root}/asked")
    dealt, written = spark.read.schema(dealt.schema).parquet(f"{root}/asked"), []
    for i in range(blocks):
        asked = dealt.where(F.col("block") == i).select(query_id, "vector").collect()
        if asked:
            found, shared = search(asked)
            found.write.parquet(f"{root}/found_{i}")
            written.append(f"{root}/found_{i}")
            shared.destroy()
    return spark.read.schema(schema).parquet(*written)


def dense_topk_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", most_queries: int = 10_000) -> DataFrame:
    """The k nearest rows of each query (query_id, vector): (query_id, id, score, rank).

    The queries are broadcast; each batch of vectors is multiplied with all of them and keeps k a query, so only
    k rows of a query leave each task. More than most_queries are held against all vectors in blocks.
    """
    queries = queries.select(F.col(query_id).cast("long").alias(query_id), "vector")
    local = in_blocks(queries, query_id, f"{query_id} long, {id_col} long, score double", most_queries, lambda asked: _nearest(vectors, asked, k, id_col, vector_col, query_id))
    if local is None:
        return vectors.select(F.lit(0).cast("long").alias(query_id), F.col(id_col).cast("long"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    # the rank is cut to k in each task before the exchange
    best = Window.partitionBy(query_id).orderBy(F.col("score").desc(), id_col)
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_id, id_col, "score", "rank")


def dimension_check(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(n, min_dim, max_dim): vectors of several sizes can't be searched."""
    return vectors.agg(F.count("*").alias("n"), F.min(F.size(vector_col)).alias("min_dim"), F.max(F.size(vector_col)).alias("max_dim"))


#: Trigrams whose hashes a worker keeps, about.
TRIGRAMS = 200_000
_hashes: dict[int, int] = {}


def trigram_sums(text: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sums) of a text that is lower case already."""
    c = np.frombuffer(f"  {text}  ".encode("utf-32-le"), np.uint32).astype(np.int64)
    keys, counts = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)
    if len(_hashes) > TRIGRAMS:
        _hashes.clear()
    found = []
    for k in keys.tolist():
        h = _hashes.get(k)
        if h is None:
            gram = chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF)
            h = _hashes[k] = int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big")
        found.append(h)
    h = np.array(found, np.int64)
    sums = np.bincount(h % dim, np.where(h >> 31 == 1, -counts, counts), dim)
    slots = np.flatnonzero(sums)
    return slots, sums[slots]


def hash_embedding(rows: DataFrame, id_col: str, text_col: str, dim: int = 384) -> DataFrame:
    """(id, slot, value): the sparse unit vector of each text's character trigrams, each hashed to a slot and a sign.

    Each text is summed in one pass, and only texts of an id that several rows share meet in a shuffle: they count as one text.
    Rows without id are left out.
    """
    texts = rows.where(F.col(id_col).isNotNull()).select(id_col, F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    again = texts.groupBy(F.col(id_col).alias("again")).count().where("count > 1").select("again")

    def run(unit: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    pairs = [trigram_sums(t, dim) for t in part.column(1).to_pylist()]
                    values = [v / max(np.sqrt((v * v).sum()), 1e-12) if unit else v for _, v in pairs]
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(len(pairs)), [len(v) for v in values])))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([x for x, _ in pairs]).astype(np.int32)), pa.array(np.concatenate(values))], names=[id_col, "slot", "value"])

        return each

    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, slot int, value double"
    n_again = again.count()
    if not n_again:
        return texts.mapInArrow(run(True), schema)
    again = F.broadcast(again) if n_again <= 1_000_000 else again
    on = texts[id_col] == F.col("again")
    sums = texts.join(again, on, "left_semi").mapInArrow(run(False), schema).groupBy(id_col, "slot").agg(F.sum("value").alias("value")).where("value <> 0")
    length = sums.groupBy(id_col).agg(F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(1e-12)).alias("length"))
    merged = sums.join(length, id_col).select(id_col, "slot", (F.col("value") / F.col("length")).alias("value"))
    return texts.join(again, on, "left_anti").mapInArrow(run(True), schema).unionByName(merged)


def embed_texts(rows: DataFrame, text_col: str, to: str, embed, dim: int) -> DataFrame:
    """rows with the vector of text_col; embed(list of texts) -> array (n, dim) is called for each Arrow batch, which a batch that is too much halves."""
    fields = [*rows.schema.fields]
    at = rows.columns.index(text_col)

    def halved(texts: list[str]) -> np.ndarray:
        try:
            return np.asarray(embed(texts), np.float32)
        except MemoryError:
            if len(texts) < 2:
                raise
            return np.concatenate([halved(texts[: len(texts) // 2]), halved(texts[len(texts) // 2 :])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = halved([t or "" for t in batch.column(at).to_pylist()]).reshape(-1, dim)
            out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float32()))], names=[*batch.schema.names, to])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(to, T.ArrayType(T.FloatType()))]))


def embed_once(rows: DataFrame, known: DataFrame | None, embed, dim: int, hash_col: str = "embedding_hash", text_col: str = "embedding_text") -> DataFrame:
    """rows with `vector`: each distinct hash is embedded once, and not at all if `known` (hash, vector) has it."""
    need = rows.select(hash_col, text_col).dropDuplicates([hash_col])
    if known is not None:
        known = known.where(F.col(hash_col) != "").dropDuplicates([hash_col]).select(hash_col, "vector")
        need = need.join(known, hash_col, "left_anti")
    made = embed_texts(need, text_col, "vector", embed, dim).select(hash_col, "vector")
    every = made if known is None else known.unionByName(made)
    return rows.join(every, hash_col, "left")
