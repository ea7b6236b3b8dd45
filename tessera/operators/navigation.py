"""Navigation over symbols, references, documents and chunks: searches by name and path, references, neighbours, maps, outlines, context.

The tables are those of tessera.sources.schemas; each function names the columns it needs, others don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.text import like_any_case, ordered_terms_pattern, query_phrases, query_terms
from tessera.operators.lexical import bm25, bm25_from_postings

#: Effective weights of a symbol's columns in full-text search.
SYMBOL_WEIGHTS = {"name": 5.0, "qualified_name": 1.0, "kind": 2.5, "path": 2.5, "signature": 1.5, "docstring": 0.4, "text": 1.0}
CHUNK_WEIGHTS = {"title": 1.2, "section": 1.8, "path": 1.0, "text": 1.0}
EXACT, SUFFIX, PATTERN = 100.0, 75.0, 40.0
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\.|::|#)[A-Za-z_$][A-Za-z0-9_$]*)*$"


def symbol_tiers(symbols: DataFrame, query: str, limit: int, where: Column | None = None, weights: dict[str, float] | None = None, path_col: str | None = "path", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, score): exact names and qualified names first, then qualified suffixes, then names, qualified names and paths that have
    the query's terms in order, then full-text hits; a symbol in several tiers has its best score. Each tier keeps `limit`; of equal scores
    what stands first in its file is kept. index: postings and statistics of the symbols, without which all are tokenised."""
    rows = symbols if where is None else symbols.where(where)
    name, qualified = F.lower("name"), F.lower("qualified_name")
    q = query.strip().lower()
    pattern = ordered_terms_pattern(query)
    like = like_any_case(F.col("name"), pattern) | like_any_case(F.col("qualified_name"), pattern)
    if path_col:
        like = like | like_any_case(F.col(path_col), pattern)

    def tier(test: Column, score: float) -> DataFrame:
        return rows.where(test).orderBy("qualified_name", "id").limit(limit).select("id", F.lit(score).alias("score"))

    found = [tier((name == q) | (qualified == q), EXACT), tier(F.endswith(qualified, F.lit("." + q)), SUFFIX), tier(like, PATTERN)]
    use = {c: w for c, w in (weights or SYMBOL_WEIGHTS).items() if c in symbols.columns}
    if index:
        words = bm25_from_postings(*index, "id", query_phrases(query), use, None if where is None else rows)
    else:
        words = bm25(symbols, "id", use, query_phrases(query), where)
    found.append(words.orderBy(F.col("score").desc(), "id").limit(limit))
    best = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("score").alias("score"))
    if "line_start" in symbols.columns:  # no more rows than the limits of four tiers
        best = symbols.select("id", "line_start").join(F.broadcast(best), "id")
        return best.orderBy(F.col("score").desc(), "line_start", "id").limit(limit).select("id", "score")
    return best.orderBy(F.col("score").desc(), "id").limit(limit)


def path_search(docs: DataFrame, query: str, limit: int, path_col: str = "path", id_col: str = "doc_id") -> DataFrame:
    """Documents whose path has each of the query's first five terms; shortest path first."""
    path = F.lower(F.col(path_col))
    test = reduce(lambda a, b: a & b, (path.contains(t.lower()) for t in query_terms(query)[:5]), F.lit(True))
    return docs.where(test).orderBy(F.length(path_col), path_col, id_col).limit(limit)


def document_path_search(docs: DataFrame, chunks: DataFrame, query: str, limit: int) -> DataFrame:
    """path_search over path or title, for documents that have a PDF chunk."""
    path, title = F.lower("path"), F.lower("title")
    test = reduce(lambda a, b: a & b, (path.contains(t.lower()) | title.contains(t.lower()) for t in query_terms(query)[:5]), F.lit(True))
    with_pdf = chunks.where(F.startswith("chunk_type", F.lit("pdf_"))).select("doc_id")
    return docs.where(test).join(with_pdf, "doc_id", "left_semi").orderBy(F.length("path"), "path", "doc_id").limit(limit)


def best_of_group(rows: DataFrame, group_col: str, rank: Column, *order: str) -> DataFrame:
    """The first row of each group by rank and order."""
    w = Window.partitionBy(group_col).orderBy(rank, *order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def chunk_rank(first: dict[str, int], type_col: str = "chunk_type", other: int = 2) -> Column:
    out = F.lit(other)
    for name, n in first.items():
        out = F.when(F.col(type_col) == name, n).otherwise(out)
    return out


def chunks_for_symbols(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, score): the best chunk of each symbol hit (id, score)."""
    own = chunks.where("symbol_id <> ''").join(hits.select(F.col("id").alias("symbol_id"), "score"), "symbol_id")
    return best_of_group(own, "symbol_id", chunk_rank({"symbol": 0, "symbol_part": 1}), "ord", "id").select("id", "score")


def chunks_for_docs(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, score): the best chunk of each document hit (doc_id, score)."""
    return best_of_group(chunks.join(hits.select("doc_id", "score"), "doc_id"), "doc_id", chunk_rank({"file_summary": 0, "imports": 1}), "ord", "id").select("id", "score")


def references(refs: DataFrame, name: str, limit: int, where: Column | None = None) -> DataFrame:
    """References to a name: to its last dotted part if there are any, else to names that contain it. One plan: the second
    kind is let through where the first, cut to its limit, is empty."""
    short = name.strip().lower().rsplit(".", 1)[-1]
    rows = refs if where is None else refs.where(where)
    exact = rows.where(F.col("target_name_lc") == short).orderBy("path", "line", "id").limit(limit)
    like = rows.where(like_any_case(F.col("target_name_lc"), f"%{short}%")).orderBy("path", "line", "id").limit(limit)
    none = exact.agg(F.count("*").alias("__n")).where("__n = 0")  # one row or none
    return exact.unionByName(like.join(F.broadcast(none)).drop("__n")).orderBy("path", "line", "id")


def callers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each reference with the symbol that it stands in; a symbol comes as often as it refers."""
    own = symbols.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("caller"), F.col("qualified_name").alias("caller_qualified"))
    return refs.where("source_symbol_id <> ''").join(own, "source_symbol_id")


def neighbors(symbols: DataFrame, refs: DataFrame, symbol_id: str, limit: int = 40) -> dict[str, DataFrame]:
    """Other symbols of the same document, references to the symbol's name, and the symbols they stand in."""
    me = symbols.where(F.col("id") == symbol_id).select("doc_id", F.col("id").alias("__me"), F.lower("name").alias("__name"))
    siblings = symbols.join(F.broadcast(me.select("doc_id", "__me")), "doc_id").where("id <> __me").drop("__me").orderBy("line_start", "line_end", "id").limit(limit)
    to_me = refs.join(F.broadcast(me.select(F.col("__name").alias("target_name_lc"))), "target_name_lc").orderBy("path", "line", "id").limit(limit)
    return {"siblings": siblings, "references": to_me, "callers": callers(to_me, symbols).orderBy("path", "line", "id")}


def repo_map(docs: DataFrame, symbols: DataFrame, limit: int, per_file: int = 25, where: Column | None = None) -> DataFrame:
    """(path, symbols): the first documents by path, each with at most per_file of its symbols in line order."""
    own = (docs if where is None else docs.where(where)).orderBy("path", "doc_id").limit(limit)
    w = Window.partitionBy("doc_id").orderBy("line_start", "line_end", "id")
    few = symbols.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi").withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_file)
    lists = few.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_start", "name", "kind", "qualified_name"))).alias("symbols"))
    return own.join(lists, "doc_id", "left").select("doc_id", "path", F.coalesce("symbols", F.expr("cast(array() as array<struct<line_start:int,name:string,kind:string,qualified_name:string>>)")).alias("symbols"))


def language_counts(docs_or_symbols: DataFrame, column: str = "language") -> DataFrame:
    return docs_or_symbols.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def adjacent(chunks: DataFrame, doc_id: str, at: int, radius: int) -> DataFrame:
    """The chunks of a document that stand up to radius before and behind a place, in order, whether or not one stands at the place itself."""
    return chunks.where((F.col("doc_id") == doc_id) & F.col("ord").between(at - radius, at + radius)).orderBy("ord", "id")


def outline(chunks: DataFrame, doc_id: str, limit: int = 500) -> DataFrame:
    """(page, section) of a document's first `limit` chunks, each pair once, where it first stands."""
    first = chunks.where(F.col("doc_id") == doc_id).orderBy("ord").limit(limit)
    return first.groupBy("page", "section").agg(F.min("ord").alias("ord")).orderBy("ord")


def find_document(docs: DataFrame, chunks: DataFrame, path_or_id: str) -> DataFrame:
    """The document with that id or path, else the PDF of shortest path that contains it."""
    exact = docs.where((F.col("doc_id") == path_or_id) | (F.col("path") == path_or_id)).withColumn("__tier", F.lit(0))
    like = docs.where(like_any_case(F.col("path"), f"%{path_or_id}%")).join(chunks.where(F.startswith("chunk_type", F.lit("pdf_"))).select("doc_id"), "doc_id", "left_semi").withColumn("__tier", F.lit(1))
    return exact.unionByName(like).orderBy("__tier", F.length("path"), "path").limit(1).drop("__tier")


def multi_get(rows: DataFrame, ids: list, id_col: str) -> DataFrame:
    """The rows of the ids, in the order they are asked for, with their position."""
    want = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"__pos int, {id_col} {dict(rows.dtypes)[id_col]}")
    return rows.join(F.broadcast(want), id_col).withColumnRenamed("__pos", "position").orderBy("position")


def enclosing(points: DataFrame, intervals: DataFrame, key: str, at: str = "line", start: str = "line_start", end: str = "line_end", id_col: str = "id", parts: int | None = None) -> DataFrame:
    """Each point (key, at) with the innermost interval of its key around it: the one that starts last, of those the shortest, then the least id.

    One sweep: starts and points of a key are sorted together, and a fold carries the intervals that are still open, innermost last. A point never meets an interval
    that is closed or not yet open, so a key of many points and intervals costs their sum and not their product. The points' columns go through the sweep with them, so
    points are made and shuffled once. parts: tasks of the sweep, for those who know how much there is.
    """
    kind, columns = dict(intervals.dtypes)[id_col], points.schema
    none = F.lit(None)
    opens = intervals.select(F.col(key).alias("__key"), F.col(start).cast("double").alias("__at"), F.lit(0).alias("__point"), F.col(end).cast("double").alias("__e"), F.col(id_col).cast("string").alias("__id"), none.cast(columns).alias("__p"))
    opens = opens.where("__key is not null and __at is not null and __e is not null")
    asked = points.select(F.col(key).alias("__key"), F.col(at).cast("double").alias("__at"), F.lit(1).alias("__point"), none.cast("double").alias("__e"), none.cast("string").alias("__id"), F.struct(*points.columns).alias("__p"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_ = None, []  # (end, id), the innermost last
        for batch in batches:
            out = []
            for k, x, is_point, e, i in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if k is None or x is None:  # a point that is nowhere
                    out.append(None)
                    continue
                if k != current:
                    current, open_ = k, []
                while open_ and open_[-1][0] < x:
                    open_.pop()
                if is_point:
                    out.append(open_[-1][1] if open_ else None)
                elif e >= x:
                    open_.append((e, i))
            held = batch.column(5).filter(pc.equal(batch.column(2), 1))
            yield pa.RecordBatch.from_arrays([held, pa.array(out, pa.string())], names=["__p", "__id"])

    # of one start, the longest comes first and the greatest id, so that the innermost is on top; points without a key are dealt out
    dealt = [F.col("__key"), F.when(F.col("__key").isNull(), F.xxhash64("__p"))]
    both = opens.unionByName(asked)
    both = (both.repartition(parts, *dealt) if parts else both.repartition(*dealt)).sortWithinPartitions("__key", "__at", "__point", F.col("__e").desc(), F.col("__id").cast(kind).desc())
    found = both.mapInArrow(sweep, StructType([StructField("__p", columns), StructField("__id", StringType())]))
    return found.select("__p.*", F.col("__id").cast(kind).alias("enclosing_id"))


def packed_hits(hits: DataFrame, chunks: DataFrame, include_text: bool = False, chars: int = 700) -> DataFrame:
    """Hits (id, score) with what a result shows of their chunks, best first."""
    from tessera.functions.text import snippet

    shown = [F.col(c) for c in ("path", "title", "section", "chunk_type", "language", "line_start", "line_end", "symbol_name", "qualified_name") if c in chunks.columns]
    uri = F.concat(F.lit("rag://"), F.col("doc_id"), F.lit("#chunk="), F.col("id")).alias("resource_uri")
    text = [F.col("text")] if include_text else []
    return chunks.join(F.broadcast(hits), "id").select("id", F.round("score", 6).alias("score"), uri, *shown, snippet(F.col("text"), chars).alias("snippet"), *text).orderBy(F.col("score").desc(), "id")
