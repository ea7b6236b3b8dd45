"""Approximate nearest vectors: inverted lists around centroids, for tables where the exact scan is too much."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dense import dense_topk, in_blocks

#: Vectors that centroids are fitted on, at most; every vector is indexed.
SAMPLE = 50_000


def fit_centroids(vectors: DataFrame, lists: int, vector_col: str = "embedding", sample: int = SAMPLE, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Unit centroids by spherical k-means on a bounded sample (the vectors of least hash)."""
    # thinned by hash before the sort, so that not every task sends `sample` rows to the driver
    low = F.xxhash64(vector_col).cast("double") <= -(2.0**63) + min(1.0, 4 * sample / max(1, vectors.count())) * 2.0**64
    rows = vectors.select(vector_col).where(low).orderBy(F.xxhash64(vector_col)).limit(sample).collect()
    x = np.array([r[0] for r in rows], np.float32)
    if not len(x):
        return np.zeros((0, 0), np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=len(centroids)) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def ivf_index(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, list) of every vector; to be written partitioned by list, so that a query reads its lists only."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # lists x dimensions, whatever the table holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float32).reshape(batch.num_rows, -1)
            own = (x @ shared.value.T).argmax(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[id_col, vector_col, "list"])

    kinds = dict(vectors.dtypes)
    return vectors.select(id_col, vector_col).mapInArrow(run, f"{id_col} {kinds[id_col]}, {vector_col} {kinds[vector_col]}, list int")


#: Share of the lists that a query looks at. Recall of ten neighbours on the embeddings at hand (2,000 of them, 45 lists), which have hardly any clusters: 0.49 at a tenth of the lists, 0.89 at half
#: of them, 0.97 at this share (0.94 on 500 of them). Clustered vectors need less.
PROBED = 0.7


def probes_of(centroids: np.ndarray) -> int:
    return max(1, int(np.ceil(PROBED * len(centroids))))


#: Queries that are held against the lists at once, cells of the table of lists and queries beside them, and scores that a task holds.
QUERIES, CELLS, SCORES = 10_000, 20_000_000, 2_000_000


class _Best:
    """The k best of each query so far, by score and then id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.across, self.k = queries, np.ascontiguousarray(queries.T), k
        self.norms = np.linalg.norm(queries, axis=1)
        self.scores, self.ids = np.full((len(queries), k), -np.inf), None

    def add(self, q: np.ndarray, asked: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Vectors x and their ids for the queries of the numbers q, asked being these.

        One matrix product tells which pairs may be among the best, within its error; their scores are then summed one dimension after another, as a
        column expression does, so equal vectors have equal scores wherever they stand.
        """
        near = asked @ x.T
        slack = 1e-12 * self.norms[q] * np.linalg.norm(x, axis=1).max()
        low = self.scores[q, -1] - slack
        many = np.flatnonzero(np.count_nonzero(near >= low[:, None], axis=1) > 4 * self.k)
        if len(many):
            low[many] = np.maximum(low[many], np.partition(near[many], -self.k, axis=1)[:, -self.k] - slack[many])
        at, row = np.nonzero(near >= low[:, None])
        at, score = q[at], np.zeros(len(at))
        for mine, own in zip(self.across, np.ascontiguousarray(x.T), strict=True):
            score += mine[at] * own[row]
        keep = score >= self.scores[at, -1]
        at, row, score = at[keep], row[keep], score[keep]
        if not len(at):
            return
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, ids.dtype)
        touched = np.unique(at)
        held = self.scores[touched] > -np.inf
        at = np.concatenate([at, np.repeat(touched, held.sum(1))])
        score = np.concatenate([score, self.scores[touched][held]])
        ids = np.concatenate([ids[row], self.ids[touched][held]])
        order = np.lexsort((ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1], -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
        keep = rank < self.k
        self.scores[at[keep], rank[keep]], self.ids[at[keep], rank[keep]] = score[keep], ids[keep]


def _in_lists(index: DataFrame, centroids: np.ndarray, asked: list, k: int, probes: int, id_col: str, vector_col: str, query_id: str) -> tuple[DataFrame, Broadcast]:
    """(query_id, id, score) of the k best of each query in each task, of the lists that the query looks at, and the broadcast queries."""
    names, queries = np.array([r[0] for r in asked], np.int64), np.array([r[1] for r in asked], np.float64)
    looks = np.zeros((len(centroids), len(names)), bool)
    for at in range(0, len(names), 1000):
        near = np.argsort(-(queries[at : at + 1000].astype(np.float32) @ centroids.T), axis=1, kind="stable")[:, :probes]
        looks[near, np.arange(at, at + len(near))[:, None]] = True
    shared = index.sparkSession.sparkContext.broadcast((names, queries, looks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, looks = shared.value
        best = _Best(queries, k)
        for batch in batches:
            ids, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            order = np.argsort(own, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                q = np.flatnonzero(looks[own[rows[0]]]) if len(rows) else rows
                mine, step = queries[q], max(1, SCORES // max(1, len(q)))
                for at in range(0, len(rows) if len(q) else 0, step):
                    best.add(q, mine, x[rows[at : at + step]], ids[rows[at : at + step]])
        if best.ids is not None:
            q, rank = np.nonzero(best.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(best.ids[q, rank], batch.schema.field(0).type), pa.array(best.scores[q, rank])], names=[query_id, id_col, "score"])

    # a list's vectors side by side, in as many tasks as there are cores: each sends k rows of a query on
    dealt = index.select(id_col, vector_col, "list").repartitionByRange(index.sparkSession.sparkContext.defaultParallelism, "list", id_col).sortWithinPartitions("list")
    return dealt.mapInArrow(run, f"{query_id} long, {id_col} {dict(index.dtypes)[id_col]}, score double"), shared


def ivf_topk_many(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """The k best of each query (query_id, vector) in its own nearest lists: (query_id, id, score, rank).

    Queries are broadcast in blocks of bounded size; the vectors of a list are multiplied with the queries that look at it and no others, and only the best k of a query
    leave a task. The work is that of queries times the vectors of their lists.
    """
    n = probes or probes_of(centroids)
    queries = queries.select(F.col(query_id).cast("long").alias(query_id), "vector")
    schema = f"{query_id} long, {id_col} {dict(index.dtypes)[id_col]}, score double"
    local = in_blocks(queries, query_id, schema, max(1, min(QUERIES, CELLS // max(1, len(centroids)))), lambda asked: _in_lists(index, centroids, asked, k, n, id_col, vector_col, query_id))
    if local is None:
        return index.select(F.lit(0).cast("long").alias(query_id), id_col, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    best = Window.partitionBy(query_id).orderBy(F.col("score").desc(), id_col)
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_id, id_col, "score", "rank")


def ivf_topk(index: DataFrame, centroids: np.ndarray, query: list[float], k: int, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best of the `probes` lists whose centroids are nearest to the query, by default PROBED of all lists."""
    probes = probes or probes_of(centroids)
    near = np.argsort(-(centroids @ np.asarray(query, np.float32)), kind="stable")[:probes]
    return dense_topk(index, query, k, id_col, vector_col, where=F.col("list").isin(near.tolist()))
