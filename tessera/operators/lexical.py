"""Full-text search: tokens, phrases and BM25 over weighted columns, and a postings table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.session import spread

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def _and_equal(word: str):
    return lambda ok, t: F.coalesce(ok & (t == word), F.lit(False))


def phrase_hits(toks: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens stand next to each other in order."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    here = F.transform(toks, lambda t: t == phrase[0])
    for i, word in enumerate(phrase[1:], 2):
        here = F.zip_with(here, F.slice(toks, i, F.greatest(F.size(toks), F.lit(1))), _and_equal(word))
    return F.size(F.filter(here, lambda ok: ok))


def bm25(rows: DataFrame, id_col: str, weights: dict[str, float], phrases: list[list[str]], scope: Column | None = None) -> DataFrame:
    """(id, score) of the rows that have a phrase in one of the columns of `weights`.

    score = sum over phrases of idf * f (K1 + 1) / (f + K1 (1 - B + B D / avg D)): f the hits weighted by their columns, D the
    tokens of all columns, idf = ln((N - n + 0.5) / (n + 0.5)), at least LEAST_IDF. scope restricts what is returned, not the
    statistics. The statistics are a single row.
    """
    if not phrases:
        return rows.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    toks = {c: tokens(F.col(c)) for c in weights}
    rows = spread(rows.select(F.col(id_col), *([] if scope is None else [scope.alias("__in")]), *weights))
    held = rows.select(F.col(id_col), *([] if scope is None else ["__in"]), *(t.alias(f"__t_{c}") for c, t in toks.items()))
    hits = [sum((F.lit(w) * phrase_hits(F.col(f"__t_{c}"), p) for c, w in weights.items()), F.lit(0.0)) for p in phrases]
    size = sum((F.size(f"__t_{c}") for c in weights), F.lit(0))
    held = held.select(F.col(id_col), *([] if scope is None else ["__in"]), size.alias("__d"), *(h.alias(f"__f{i}") for i, h in enumerate(hits)))
    # dealt anew as numbers, so that both uses below read the same exchange and texts are tokenised once
    held = held.repartition(F.col(id_col))
    stats = held.agg(F.count("*").alias("__n"), *([] if scope is None else [F.count_if("__in").alias("__scoped")]), F.avg("__d").alias("__avg"), *(F.count_if(F.col(f"__f{i}") > 0).alias(f"__n{i}") for i in range(len(phrases))))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        n, f = F.col(f"__n{i}"), F.col(f"__f{i}")
        idf = F.ln((F.col("__n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__d") / F.col("__avg")))).otherwise(0.0)
    found = held if scope is None else held.where("__in")
    # stats has one row. A test of the hits themselves would be pushed below the tokens and make them once for each mention.
    return found.crossJoin(F.broadcast(stats)).select(F.col(id_col), score.alias("score")).where("score > 0")


def top(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


#: Tokens whose postings are made at once, about (the tokens of one row are never parted).
TOKENS = 1_000_000


def _postings_of(ids: list[pa.Array], toks: list[pa.Array], columns: list[str]) -> list[pa.Array]:
    """The postings of some rows, sorted by term, row and column: term, the ids, column, size, hits, positions."""
    n, m = len(ids[0]), len(toks)
    lengths = np.stack([pc.list_value_length(t).to_numpy(zero_copy_only=False) for t in toks]).astype(np.int64)
    words = pc.dictionary_encode(pa.concat_arrays([t.flatten() for t in toks]))
    by_term = pc.array_sort_indices(words.dictionary)
    rank = np.empty(len(by_term), np.int64)
    rank[by_term.to_numpy()] = np.arange(len(by_term))
    runs = lengths.ravel()
    place = np.repeat(np.add.outer(np.arange(m), np.arange(n) * m).ravel(), runs)  # row and column of each token
    position = np.arange(len(place)) - np.repeat(np.cumsum(runs) - runs, runs)
    key = rank[words.indices.to_numpy()] * (n * m) + place
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    row, column = np.divmod(key[starts] % (n * m), m)
    ends = np.append(starts, len(key))
    at = pa.array(row)
    return [
        words.dictionary.take(by_term.take(pa.array(key[starts] // (n * m)))), *(i.take(at) for i in ids), pa.array(columns).take(pa.array(column)), pa.array(lengths.sum(0)[row].astype(np.int32)),
        pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(position[order].astype(np.int32))),
    ]


def postings(rows: DataFrame, id_col: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """The inverted index (term, id, column, hits, positions, size of the row, and the columns in keep).

    Nothing is shuffled: each task gives the postings of its rows in runs sorted by term, so that, as they are written, a query's terms prune pages of every file.
    """
    own = [id_col, *(keep or [])]
    held = spread(rows.select(*own, *columns)).select(*own, *(tokens(F.col(c)).alias(f"__t{i}") for i, c in enumerate(columns)))
    names = ["term", *own, "column", "size", "hits", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(sum(pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[len(own) :]))
            cuts = [0, *(np.flatnonzero(np.diff(upto // TOKENS)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a).columns
                    out = pa.RecordBatch.from_arrays(_postings_of(part[: len(own)], part[len(own) :], columns), names=names)
                    yield from (out.slice(i, 50_000) for i in range(0, out.num_rows, 50_000))

    kinds = dict(rows.dtypes)
    return held.mapInArrow(run, f"term string, {', '.join(f'`{c}` {kinds[c]}' for c in own)}, column string, size int, hits int, positions array<int>")


def sizes(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, tokens): how many rows a document has in the index, and how many tokens these have; summed, the statistics of BM25."""
    toks = index.groupBy(key).agg(F.sum("hits").alias("tokens"))
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).join(toks, key, "left").select(key, "n_rows", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))


def statistics(sized: DataFrame) -> DataFrame:
    """One row (n_rows, avg_size) of sizes()."""
    return sized.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.try_divide(F.sum("tokens"), F.sum("n_rows")).alias("avg_size"))


def document_frequencies(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """(term, df, tf): rows with the term, and its occurrences. Counted within each row first, so a frequent term shuffles as a few partial sums."""
    counted = spread(rows.select(id_col, column)).select(F.explode(tokens(F.col(column))).alias("term"), F.col(id_col)).groupBy("term", id_col).agg(F.count("*").alias("n"))
    return counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def bm25_from_postings(index: DataFrame, stats: DataFrame, id_col: str, phrases: list[list[str]], weights: dict[str, float], scoped: DataFrame | None = None) -> DataFrame:
    """(id, score) as bm25() gives them, from a postings table: only rows of the query's terms are read, and no text is tokenised.

    A phrase of several tokens is where the positions of its terms, each less its place in the phrase, are the same. stats: one row (n_rows, avg_size).
    scoped: the ids that may be returned; the statistics are those of all rows.
    """
    if not phrases:
        return index.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    terms = sorted({t for p in phrases for t in p})
    asked = F.array(*(F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(len(p)).alias("n")) for k, p in enumerate(phrases) for i, t in enumerate(p)))
    rows = index.where(F.col("term").isin(terms) & F.col("column").isin(list(weights)))
    rows = rows.withColumn("a", F.explode(F.filter(asked, lambda x: x["t"] == F.col("term"))))
    keys = ["a.phrase", id_col, "size", "column"]
    single = rows.where("a.n = 1").select(*keys, F.col("hits").cast("long").alias("hits"))
    several = rows.where("a.n > 1").select(*keys, "a.n", F.explode(F.transform("positions", lambda x: x - F.col("a.i"))).alias("at"))
    several = several.groupBy("phrase", id_col, "size", "column", "at", "n").agg(F.count("*").alias("k")).where("k = n").groupBy("phrase", id_col, "size", "column").agg(F.count("*").alias("hits"))
    weight = F.element_at(F.create_map(*(F.lit(x) for c, w in weights.items() for x in (c, float(w)))), F.col("column"))
    hits = (single.unionByName(several) if any(len(p) > 1 for p in phrases) else single).groupBy("phrase", id_col, "size").agg(F.sum(F.col("hits") * weight).alias("f"))
    dfs = F.broadcast(hits.groupBy("phrase").agg(F.count("*").alias("n")))  # as many rows as phrases
    idf = F.ln((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))
    found = hits if scoped is None else hits.join(scoped.select(id_col), id_col, "left_semi")
    # a phrase's part stands alone in its sum, and the parts are added in the order of the phrases: rows that are alike have equal scores, whatever order they come in
    parts = [F.coalesce(F.sum(F.when(F.col("phrase") == k, part)), F.lit(0.0)) for k in range(len(phrases))]
    return found.join(dfs, "phrase").crossJoin(F.broadcast(stats)).groupBy(id_col).agg(reduce(add, parts).alias("score")).where("score > 0")
