"""The registered queries of the engine's own operators, each beside the SQL that gives the same rows.

The driver's tables stand in for an index: documents and conversations for documents and chunks, part for symbols, lineitem,
orders and customer for references, pages for paths, embeddings for vectors. Every query runs over its whole tables; limits are
those of top-k operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import FOLD_FROM, FOLD_TO, clean_page_text, fetch_text, is_binary, normalized_lines, ordered_terms_pattern, path_prefix, query_phrases, query_terms_column, snippet, stable_id
from tessera.functions.vectors import norm, normalized
from tessera.operators import ann, chunks, dense, documents, extract, fusion, lexical, navigation, pdf_blocks, reconcile
from tessera.session import shared_folder
from tessera.settings import Settings
from tessera.sources import scan

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

QUERY = "the licensed version of apache"
PHRASES = query_phrases(QUERY)
VECTOR_ID = 7


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- full text ---------------------------------------------------------------------------------------------


def _toks_sql(column: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({column}, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(table: str, id_col: str, weights: dict[str, float], phrases: list[list[str]], scope: str = "true") -> str:
    """A SELECT of (id, score) that does what lexical.bm25 does."""

    def hits(col: str, p: list[str]) -> str:
        if len(p) == 1:
            return f"len(list_filter({col}, lambda x: x = '{p[0]}'))"
        want = "[" + ", ".join(f"'{x}'" for x in p) + "]"
        return f"len(list_filter(range(1, greatest(len({col}) - {len(p)} + 2, 1)), lambda i: list_slice({col}, i, i + {len(p) - 1}) = {want}))"

    toks = ", ".join(f"{_toks_sql(c)} AS t_{c}" for c in weights)
    fs = ", ".join("(" + " + ".join(f"{w}::DOUBLE * {hits(f't_{c}', p)}" for c, w in weights.items()) + f") AS f{i}" for i, p in enumerate(phrases))
    size = " + ".join(f"len(t_{c})" for c in weights)
    counts = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))
    idf = "CASE WHEN ln((n - {0} + 0.5::DOUBLE) / ({0} + 0.5::DOUBLE)) > 0 THEN ln((n - {0} + 0.5::DOUBLE) / ({0} + 0.5::DOUBLE)) ELSE 1e-6 END"
    score = " + ".join(
        f"CASE WHEN f{i} > 0 THEN ({idf.format(f'n{i}')}) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / a)) ELSE 0 END" for i in range(len(phrases))
    )
    some = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return (
        f"(WITH t AS (SELECT {id_col}, ({scope}) AS ok, {toks} FROM {table}), f AS (SELECT {id_col}, ok, ({size}) AS d, {fs} FROM t), "
        f"s AS (SELECT count(*) AS n, avg(d) AS a, {counts} FROM f) SELECT {id_col}, {score} AS score FROM f, s WHERE ok AND ({some}))"
    )


_indexes: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _index(rows: DataFrame, sf_dir: str, table: str, id_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics of a table's columns: written, each task's sorted by term in runs, when a session first asks for them, and read by each query from then on."""
    spark = rows.sparkSession
    key = (spark.sparkContext.applicationId, sf_dir, table, *columns)
    if key not in _indexes:
        index, root = lexical.postings(rows, id_col, columns), shared_folder(spark, "index")
        index.write.parquet(f"{root}/postings")
        index = spark.read.schema(index.schema).parquet(f"{root}/postings")
        stats = lexical.statistics(lexical.sizes(index, rows, id_col))
        stats.write.parquet(f"{root}/stats")
        _indexes[key] = index, spark.read.schema(stats.schema).parquet(f"{root}/stats")
    return _indexes[key]


def _words(spark: SparkSession, sf_dir: str, table: str, id_col: str, weights: dict[str, float], phrases: list[list[str]], scoped: DataFrame | None = None) -> DataFrame:
    return lexical.bm25_from_postings(*_index(_t(spark, sf_dir, table), sf_dir, table, id_col, list(weights)), id_col, phrases, weights, scoped)


@_register(f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql('documents', 'doc_id', {'text': 1.0}, PHRASES)} x ORDER BY x.score DESC, doc_id LIMIT 20")
def kw_bm25_topk(spark, sf_dir):
    return lexical.top(_words(spark, sf_dir, "documents", "doc_id", {"text": 1.0}, PHRASES), "doc_id", 20).select("doc_id", _r("score").alias("score"))


_PART_WEIGHTS = {"p_name": 5.0, "p_brand": 1.0, "p_type": 2.5}


@_register(f"SELECT p_partkey, round(score, 6) AS score FROM {bm25_sql('part', 'p_partkey', _PART_WEIGHTS, query_phrases('red Brand#2 ECONOMY widget'))}")
def kw_bm25_multicol_weighted(spark, sf_dir):
    return _words(spark, sf_dir, "part", "p_partkey", _PART_WEIGHTS, query_phrases("red Brand#2 ECONOMY widget")).select("p_partkey", _r("score").alias("score"))


@_register(f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql('documents', 'doc_id', {'text': 1.0}, [['general', 'public', 'license'], ['version', '3']])}")
def kw_phrase(spark, sf_dir):
    return _words(spark, sf_dir, "documents", "doc_id", {"text": 1.0}, query_phrases("general-public-license version.3")).select("doc_id", _r("score").alias("score"))


_SCOPE_SQL = "lang = 'en' AND source ILIKE 'src1%'"


@_register(f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql('documents', 'doc_id', {'text': 1.0, 'source': 1.8}, PHRASES, _SCOPE_SQL)} x ORDER BY x.score DESC, doc_id LIMIT 50")
def kw_scoped(spark, sf_dir):
    scope = (F.col("lang") == "en") & path_prefix(F.col("source"), "src1")
    return lexical.top(_words(spark, sf_dir, "documents", "doc_id", {"text": 1.0, "source": 1.8}, PHRASES, _t(spark, sf_dir, "documents").where(scope)), "doc_id", 50).select("doc_id", _r("score").alias("score"))


@_register(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_toks_sql('text')}) AS term FROM documents) GROUP BY term")
def term_df_stats(spark, sf_dir):
    return lexical.document_frequencies(_t(spark, sf_dir, "documents"), "doc_id", "text")


@_register(f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql('documents', 'doc_id', {'text': 1.0}, [['licensed'], ['apache'], ['mit']])}")
def kw_postings_index(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("title", F.lit(""))
    index = lexical.postings(docs, "doc_id", ["text"])  # built here and now, as an index run does
    stats = lexical.statistics(lexical.sizes(index, docs, "doc_id"))
    return lexical.bm25_from_postings(index, stats, "doc_id", [["licensed"], ["apache"], ["mit"]], {"text": 1.0}).select("doc_id", _r("score").alias("score"))


@_register(
    "WITH t AS (SELECT item_id, list_slice(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_.$/@:-]+'), lambda x: length(x) >= 2), 1, 32) AS terms FROM benchmark) "
    "SELECT item_id, len(terms)::INTEGER AS n_terms, array_to_string(terms, ' ') AS terms FROM t"
)
def query_terms_split(spark, sf_dir):
    terms = query_terms_column(F.col("text"))
    return _t(spark, sf_dir, "benchmark").select("item_id", F.size(terms).alias("n_terms"), F.array_join(terms, " ").alias("terms"))


# --- vectors -----------------------------------------------------------------------------------------------

_DENSE_SQL = f"(SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {VECTOR_ID})) AS score FROM embeddings)"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _t(spark, sf_dir, "embeddings").where(F.col("vec_id") == VECTOR_ID).select("embedding").first()
    return list(row[0]) if row else []


@_register(f"SELECT vec_id, round(score, 6) AS score FROM {_DENSE_SQL} e ORDER BY e.score DESC, vec_id LIMIT 20")
def dense_topk(spark, sf_dir):
    return dense.dense_topk(_t(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20).select("vec_id", _r("score").alias("score"))


@_register(f"SELECT vec_id, round(score, 6) AS score FROM {_DENSE_SQL} e WHERE label = 1 ORDER BY e.score DESC, vec_id LIMIT 20")
def dense_topk_prefilter(spark, sf_dir):
    return dense.dense_topk(_t(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, where=F.col("label") == 1).select("vec_id", _r("score").alias("score"))


@_register(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM {_DENSE_SQL} e ORDER BY e.score DESC, vec_id LIMIT 60) WHERE label = 1")
def dense_topk_postfilter(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    hits = dense.dense_topk(vectors, _query_vector(spark, sf_dir), 60)
    return vectors.where("label = 1").join(F.broadcast(hits), "vec_id").select("vec_id", _r("score").alias("score"))


@_register(
    "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 3), p AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], v) AS s FROM embeddings, q), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rn FROM p) SELECT query_id, vec_id, round(s, 6) AS score, rn::INTEGER AS rank FROM r WHERE rn <= 3"
)
def dense_topk_batch(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings")
    asked = vectors.where("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.dense_topk_many(vectors, asked, 3).select("query_id", "vec_id", _r("score").alias("score"), "rank")


@_register("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings) SELECT vec_id, round(l, 6) AS length, round(v[1] / greatest(l, 1e-12), 6) AS first FROM n")
def l2_normalize(spark, sf_dir):
    unit = normalized(F.col("embedding"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", _r(norm(F.col("embedding"))).alias("length"), _r(F.get(unit, F.lit(0))).alias("first"))


@_register(
    "WITH p AS (SELECT item_id, '  ' || lower(text) || '  ' AS t FROM benchmark), g AS (SELECT item_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM p), "
    "h AS (SELECT item_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT AS h FROM g), s AS (SELECT item_id, (h % 384)::INTEGER AS slot, sum(CASE WHEN (h >> 31) = 1 THEN -1 ELSE 1 END)::DOUBLE AS v FROM h GROUP BY ALL HAVING v <> 0), "
    "l AS (SELECT item_id, greatest(sqrt(sum(v * v)), 1e-12) AS l FROM s GROUP BY item_id) SELECT item_id, slot, round(v / l, 6) AS value FROM s JOIN l USING (item_id)"
)
def hash_embed_trigram(spark, sf_dir):
    return dense.hash_embedding(_t(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "slot", _r("value").alias("value"))


@_register(
    "WITH p AS (SELECT doc_id, '  ' || lower(coalesce(text, '')) || '  ' AS t FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM p), "
    "h AS (SELECT doc_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT AS h FROM g), s AS (SELECT doc_id, (h % 384)::INTEGER AS slot, sum(CASE WHEN (h >> 31) = 1 THEN -1 ELSE 1 END)::DOUBLE AS v FROM h GROUP BY ALL HAVING v <> 0), "
    "l AS (SELECT doc_id, greatest(sqrt(sum(v * v)), 1e-12) AS l FROM s GROUP BY doc_id) SELECT doc_id, slot, round(v / l, 6) AS value FROM s JOIN l USING (doc_id)"
)
def hash_embed_trigram_documents(spark, sf_dir):
    return dense.hash_embedding(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "slot", _r("value").alias("value"))


@_register("SELECT count(*) AS n, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim FROM embeddings")
def vector_dim_check(spark, sf_dir):
    return dense.dimension_check(_t(spark, sf_dir, "embeddings"))


# --- fusion ------------------------------------------------------------------------------------------------

_BM25_DOCS = bm25_sql("documents", "doc_id", {"text": 1.0}, PHRASES)


@_register(
    f"WITH d AS (SELECT vec_id AS id, score FROM {_DENSE_SQL} e ORDER BY e.score DESC, vec_id LIMIT 120), s AS (SELECT doc_id AS id, score FROM {_BM25_DOCS} b ORDER BY b.score DESC, doc_id LIMIT 120), "
    "p AS (SELECT doc_id AS id, 1.0 / row_number() OVER (ORDER BY length(source), source, doc_id) AS score FROM documents WHERE contains(lower(source), 'src1') ORDER BY length(source), source, doc_id LIMIT 120), "
    "u AS (SELECT id, 'dense' AS src, 0.5 AS w, row_number() OVER (ORDER BY score DESC, id) AS r, 0 AS o FROM d UNION ALL SELECT id, 'fts', 0.38, row_number() OVER (ORDER BY score DESC, id), 1 FROM s UNION ALL SELECT id, 'path', 0.55, row_number() OVER (ORDER BY score DESC, id), 2 FROM p), "
    "f AS (SELECT id, sum(w::DOUBLE / (60 + r)) AS score, min(struct_pack(o := o, r := r)) AS first, string_agg(src, ',' ORDER BY src) AS sources FROM u GROUP BY id) "
    "SELECT id AS doc_id, round(score, 6) AS score, sources FROM f ORDER BY f.score DESC, first, id LIMIT 32"
)
def hybrid_rrf(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    near = dense.dense_topk(_t(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 120).withColumnRenamed("vec_id", "doc_id")
    words = lexical.top(_words(spark, sf_dir, "documents", "doc_id", {"text": 1.0}, PHRASES), "doc_id", 120)
    paths = navigation.path_search(docs, "src1", 120, path_col="source")
    paths = paths.select("doc_id", (1.0 / F.row_number().over(Window.orderBy(F.length("source"), "source", "doc_id"))).alias("score"))  # 120 rows
    fused = fusion.fuse({"dense": near, "fts": words, "path": paths}, {"dense": 0.5, "fts": 0.38, "path": 0.55}, "doc_id", 32)
    return fused.select("doc_id", _r("score").alias("score"), F.array_join("sources", ",").alias("sources"))


_TIERS_SQL = (
    "(WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_type AS kind FROM part), "
    "a AS (SELECT id, 100.0 AS score FROM s WHERE lower(name) = 'small ring' OR lower(qualified_name) = 'small ring' ORDER BY qualified_name, id LIMIT 60), "
    "b AS (SELECT id, 75.0 AS score FROM s WHERE ends_with(lower(qualified_name), '.small ring') ORDER BY qualified_name, id LIMIT 60), "
    "c AS (SELECT id, 40.0 AS score FROM s WHERE name ILIKE '%small%ring%' OR qualified_name ILIKE '%small%ring%' ORDER BY qualified_name, id LIMIT 60), "
    f"d AS (SELECT id, score FROM {bm25_sql('s', 'id', {'name': 5.0, 'qualified_name': 1.0, 'kind': 2.5}, [['small'], ['ring']])} x ORDER BY x.score DESC, id LIMIT 60) "
    "SELECT id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d) GROUP BY id ORDER BY 2 DESC, id LIMIT 60)"
)


def _parts_as_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("kind"))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _parts_as_symbols(spark, sf_dir)
    return navigation.symbol_tiers(symbols, "small ring", 60, path_col=None, index=_index(symbols, sf_dir, "symbols", "id", ["name", "qualified_name", "kind"]))


@_register(f"SELECT id, round(score, 6) AS score FROM {_TIERS_SQL}")
def symbol_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir).select("id", _r("score").alias("score"))


@_register(
    f"WITH a AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM {_TIERS_SQL}), b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM "
    f"(SELECT p_partkey AS id, score FROM {bm25_sql('part', 'p_partkey', _PART_WEIGHTS, [['ring'], ['economy']])} x ORDER BY x.score DESC, p_partkey LIMIT 120)), "
    "u AS (SELECT id, 0.82::DOUBLE / (60 + r) + 0.0005::DOUBLE * greatest(0.0, score) AS s, 0 AS o, r FROM a UNION ALL SELECT id, 0.38::DOUBLE / (60 + r), 1, r FROM b), f AS (SELECT id, sum(s) AS score, min(struct_pack(o := o, r := r)) AS first FROM u GROUP BY id) "
    "SELECT id, round(score, 6) AS score FROM f ORDER BY f.score DESC, first, id LIMIT 32"
)
def rrf_raw_bonus(spark, sf_dir):
    tiers = _tiers(spark, sf_dir)
    words = lexical.top(_words(spark, sf_dir, "part", "p_partkey", _PART_WEIGHTS, [["ring"], ["economy"]]), "p_partkey", 120).withColumnRenamed("p_partkey", "id")
    return fusion.fuse({"symbol": tiers, "fts": words}, {"symbol": 0.82, "fts": 0.38}, "id", 32, bonus={"symbol": 0.0005}).select("id", _r("score").alias("score"))


# --- navigation --------------------------------------------------------------------------------------------


@_register("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example') AND contains(lower(url), 'net') AND contains(lower(url), 'en') ORDER BY length(url), url, page_id LIMIT 50")
def path_search_and_terms(spark, sf_dir):
    return navigation.path_search(_t(spark, sf_dir, "pages"), "example net EN", 50, path_col="url", id_col="page_id").select("page_id", "url")


@_register("SELECT page_id, url FROM pages WHERE url ILIKE 'HTTPS://%'")
def path_prefix_filter(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where(path_prefix(F.col("url"), "HTTPS://")).select("page_id", "url")


@_register("SELECT page_id, url FROM pages WHERE starts_with(url, 'http://th')")
def path_prefix_strict(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where(path_prefix(F.col("url"), "http://th", strict=True)).select("page_id", "url")


@_register("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red%widget%'")
def like_ordered_terms(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(F.col("p_name").ilike(ordered_terms_pattern("Red, widget"))).select("p_partkey", "p_name")


@_register("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def docs_exists_child(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


def _parts_as_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("target_name_lc"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"))


_REFS_SQL = "(SELECT p_partkey AS id, lower(p_name) AS target_name_lc, p_brand AS path, p_size AS line FROM part)"


def _references_sql(name: str) -> str:
    return (
        f"WITH r AS {_REFS_SQL}, e AS (SELECT * FROM r WHERE target_name_lc = '{name}' ORDER BY path, line, id LIMIT 80), "
        f"f AS (SELECT * FROM r WHERE target_name_lc ILIKE '%{name}%' AND NOT EXISTS (SELECT 1 FROM e) ORDER BY path, line, id LIMIT 80) SELECT id, target_name_lc, path, line FROM (SELECT * FROM e UNION ALL SELECT * FROM f)"
    )


@_register(_references_sql("small ring"))
def refs_exact(spark, sf_dir):
    return navigation.references(_parts_as_refs(spark, sf_dir), "Brand.small ring", 80)


@_register(_references_sql("ring"))
def refs_exact_then_fuzzy(spark, sf_dir):
    return navigation.references(_parts_as_refs(spark, sf_dir), "a.b.Ring", 80)


@_register(
    "SELECT l.l_orderkey, l.l_linenumber, c.c_name AS caller, o.o_orderstatus AS kind FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey"
)
def callers_join(spark, sf_dir):
    refs = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("source_symbol_id"))
    symbols = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_custkey").alias("qualified_name"))
    found = navigation.callers(refs.where(F.col("source_symbol_id").isNotNull()).withColumn("source_symbol_id", F.col("source_symbol_id").cast("string")), symbols.withColumn("id", F.col("id").cast("string")))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("caller_qualified"), F.col("c_name"))
    return found.join(customers, "caller_qualified").select("l_orderkey", "l_linenumber", F.col("c_name").alias("caller"), F.col("caller").alias("kind"))


def _nations_as_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("qualified_name"), F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("line_start"), F.col("n_nationkey").alias("line_end"))


@_register("SELECT id, name FROM (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) AND n_nationkey <> 7 ORDER BY n_nationkey LIMIT 40)")
def neighbors_siblings(spark, sf_dir):
    refs = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("target_name_lc"), F.col("s_name").alias("path"), F.col("s_nationkey").alias("line"), F.col("s_nationkey").cast("string").alias("source_symbol_id"))
    return navigation.neighbors(_nations_as_symbols(spark, sf_dir), refs, 7)["siblings"].select("id", "name")


@_register(
    "WITH s AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer), d AS (SELECT n_nationkey, n_name FROM nation ORDER BY n_name, n_nationkey LIMIT 240) "
    "SELECT d.n_name AS path, count(s.c_name) AS n_symbols, coalesce(string_agg(s.c_name, ',' ORDER BY s.rn), '') AS names FROM d LEFT JOIN s ON s.c_nationkey = d.n_nationkey AND s.rn <= 25 GROUP BY d.n_nationkey, d.n_name"
)
def repo_map_capped(spark, sf_dir):
    docs = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("path"))
    symbols = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("qualified_name"), F.col("c_custkey").cast("int").alias("line_start"), F.col("c_custkey").cast("int").alias("line_end"))
    found = navigation.repo_map(docs, symbols, 240)
    return found.select("path", F.size("symbols").cast("long").alias("n_symbols"), F.array_join(F.transform("symbols", lambda s: s["name"]), ",").alias("names"))


@_register("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark, sf_dir):
    return navigation.language_counts(_t(spark, sf_dir, "documents"), "lang")


def _conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.col("role").alias("chunk_type"), F.col("role").alias("section"),
        F.floor(F.col("turn") / 2).alias("page"), F.concat(F.lit("s"), "conv_id").alias("symbol_id"), "text",
    )


_CONV_SQL = "(SELECT conv_id || ':' || turn AS id, conv_id::VARCHAR AS doc_id, turn::INTEGER AS ord, role AS chunk_type, (turn // 2)::BIGINT AS page, text FROM conversations)"


@_register(f"SELECT id, 1.0::DOUBLE AS score FROM (SELECT id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE chunk_type WHEN 'symbol' THEN 0 WHEN 'symbol_part' THEN 1 ELSE 2 END, ord, id) AS rn FROM {_CONV_SQL}) WHERE rn = 1")
def best_chunk_per_symbol(spark, sf_dir):
    chunks = _conversation_chunks(spark, sf_dir)
    hits = chunks.select(F.col("symbol_id").alias("id")).distinct().withColumn("score", F.lit(1.0))
    return navigation.chunks_for_symbols(chunks, hits)


@_register(f"SELECT doc_id, id, chunk_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE chunk_type WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, ord, id) AS rn FROM {_CONV_SQL}) WHERE rn = 1")
def best_chunk_per_doc(spark, sf_dir):
    rank = navigation.chunk_rank({"assistant": 0, "user": 1})
    return navigation.best_of_group(_conversation_chunks(spark, sf_dir), "doc_id", rank, "ord", "id").select("doc_id", "id", "chunk_type")


@_register("SELECT conv_id || ':' || turn AS id, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS context_chars FROM conversations")
def adjacent_context(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(-1, 1)
    return _conversation_chunks(spark, sf_dir).select("id", F.sum(F.length("text")).over(w).alias("context_chars"))


@_register(f"SELECT id, ord FROM {_CONV_SQL} WHERE doc_id = '3' AND abs(ord - 2) <= 1")
def adjacent_chunks(spark, sf_dir):
    return navigation.adjacent(_conversation_chunks(spark, sf_dir), "3", 2, 1).select("id", "ord")


@_register(f"SELECT page, section, min(ord) AS ord FROM (SELECT page, chunk_type AS section, ord FROM {_CONV_SQL} WHERE doc_id = '3' ORDER BY ord LIMIT 500) GROUP BY page, section")
def outline_distinct(spark, sf_dir):
    return navigation.outline(_conversation_chunks(spark, sf_dir), "3")


@_register("SELECT doc_id, n_chars, position::INTEGER AS position FROM documents JOIN (VALUES (17, 0), (3, 1), (99, 2), (5, 3)) v(id, position) ON doc_id = id")
def multi_get_ordered(spark, sf_dir):
    return navigation.multi_get(_t(spark, sf_dir, "documents"), [17, 3, 99, 5], "doc_id").select("doc_id", "n_chars", "position")


@_register(
    "WITH i AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 90 * 86400000000 AS e FROM orders), "
    "q AS (SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, epoch_us(l.l_shipdate) AS at, row_number() OVER () AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey), "
    "b AS (SELECT q.n, i.o_orderkey, row_number() OVER (PARTITION BY q.n ORDER BY i.s DESC, i.e - i.s, i.o_orderkey) AS rn FROM q JOIN i ON q.o_custkey = i.o_custkey AND q.at BETWEEN i.s AND i.e) "
    "SELECT q.l_orderkey, q.l_linenumber, b.o_orderkey AS enclosing_id FROM q LEFT JOIN b ON q.n = b.n AND b.rn = 1"
)
def interval_enclosing(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("s"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("line"))
    points = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    spans = orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("s").alias("line_start"), (F.col("s") + 90 * 86_400_000_000).alias("line_end"))
    return navigation.enclosing(points, spans, "o_custkey").select("l_orderkey", "l_linenumber", "enclosing_id")


@_register("SELECT event_id, lead(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_start FROM events")
def next_match_lead(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.lead("event_id", 1, -1).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_start"))


@_register("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) - 1 AS occurrence FROM documents")
def occurrence_number(spark, sf_dir):
    key = F.sha2("text", 256)
    return _t(spark, sf_dir, "documents").select("doc_id", (F.row_number().over(Window.partitionBy(key).orderBy("doc_id")) - 1).cast("long").alias("occurrence"))


# --- rows of results -----------------------------------------------------------------------------------------


@_register(
    "SELECT doc_id, CASE WHEN length(trim(text)) > 700 THEN rtrim(substr(trim(text), 1, 700)) || '…' ELSE trim(text) END AS snippet, CASE WHEN length(text) > 16000 THEN substr(text, 1, 16000) || chr(10) || '...[truncated]' ELSE text END AS body, 'rag://' || doc_id AS uri FROM documents"
)
def snippet_pack(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"), fetch_text(F.col("text")).alias("body"), F.concat(F.lit("rag://"), F.col("doc_id")).alias("uri"))


@_register("SELECT event_id, (props->>'k')::INTEGER AS k, json_keys(props)[1] AS key FROM events")
def json_metadata_extract(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.get(F.json_object_keys("props"), F.lit(0)).alias("key"))


@_register(
    "SELECT page_id, contains(html, chr(0)) OR length(substr(html, 1, 4096)) - length(regexp_replace(substr(html, 1, 4096), '[\\x00-\\x08\\x0e-\\x1f]', '', 'g')) > 0.08 * greatest(length(substr(html, 1, 4096)), 1) AS is_binary, "
    "sha256(html) AS content_hash, length(regexp_replace(html, '\\r\\n?', chr(10), 'g')) AS n_chars FROM pages"
)
def binary_sniff_and_normalize(spark, sf_dir):
    content = F.col("html").cast("binary")
    return _t(spark, sf_dir, "pages").select("page_id", is_binary(content).alias("is_binary"), F.sha2(content, 256).alias("content_hash"), F.length(normalized_lines(F.col("html"))).cast("long").alias("n_chars"))


@_register("SELECT doc_id, substr(sha256(concat_ws(chr(31), 'chunk-v1', source, lang, trim(text))), 1, 24) AS chunk_id FROM documents")
def stable_ids(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", stable_id("chunk-v1", F.col("source"), F.col("lang"), F.trim("text"), length=24).alias("chunk_id"))


# --- the index as tables ---------------------------------------------------------------------------------------


@_register(
    "SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM conversations) AS chunks, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM lineitem) AS refs, (SELECT count(*) FROM embeddings) AS vectors, "
    "(SELECT count(*) FROM conversations WHERE role = 'user') AS pdf_chunks, (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'user') AS pdf_documents"
)
def corpus_stats(spark, sf_dir):
    chunks = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "pdf_text").otherwise("text").alias("chunk_type"))
    tables = {"docs": "documents", "symbols": "part", "refs": "lineitem", "vectors": "embeddings"}
    return reconcile.statistics({k: _t(spark, sf_dir, v) for k, v in tables.items()} | {"chunks": chunks})


@_register("SELECT sha256(text) AS embedding_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def exact_dup_embedding_dedup(spark, sf_dir):
    hashed = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("embedding_hash"))
    return hashed.groupBy("embedding_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@_register("SELECT sha256(text) AS embedding_hash, (min_by(embedding, vec_id))[1]::DOUBLE AS first FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY 1")
def vector_reuse_cache(spark, sf_dir):
    chunks = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("embedding_hash"))
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return reconcile.vector_cache(chunks, vectors).select("embedding_hash", F.get("vector", F.lit(0)).cast("double").alias("first"))


_NOW_SQL = "(SELECT doc_id, sha256(text) AS h, n_chars AS m, n_chars AS z FROM documents WHERE source <> 'src7')"
_OLD_SQL = "(SELECT doc_id, CASE WHEN source = 'src3' THEN sha256(source || text) ELSE sha256(text) END AS h, CASE WHEN source = 'src5' THEN n_chars + 1 ELSE n_chars END AS m, n_chars AS z FROM documents WHERE lang <> 'fr')"


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents")
    now = docs.where("source <> 'src7'").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("mtime_ns"), F.col("n_chars").alias("size_bytes"))
    edited = F.when(F.col("source") == "src3", F.sha2(F.concat("source", "text"), 256)).otherwise(F.sha2("text", 256))
    old = docs.where("lang <> 'fr'").select("doc_id", edited.alias("content_hash"), F.when(F.col("source") == "src5", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("mtime_ns"), F.col("n_chars").alias("size_bytes"))
    return now, old


@_register(
    f"SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'missing' WHEN n.h <> o.h THEN 'changed' WHEN n.m = o.m AND n.z = o.z THEN 'same' ELSE 'touched' END AS status FROM {_NOW_SQL} n FULL JOIN {_OLD_SQL} o ON n.doc_id = o.doc_id"
)
def manifest_diff_status(spark, sf_dir):
    return reconcile.manifest_diff(*_manifests(spark, sf_dir))


@_register("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_stale(spark, sf_dir):
    left = reconcile.delete_missing({"docs": _t(spark, sf_dir, "documents")}, _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti"))
    return left["docs"].select("doc_id", "source")


@_register(
    "WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'docs' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'chunks', count(*) FROM conversations WHERE conv_id NOT IN (SELECT * FROM gone) "
    "UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id IN (SELECT conv_id FROM conversations WHERE conv_id NOT IN (SELECT * FROM gone))"
)
def cascade_delete(spark, sf_dir):
    chunks = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("conv_id").alias("id"))
    tables = {"docs": _t(spark, sf_dir, "documents"), "chunks": chunks, "vectors": _t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")}
    left = reconcile.delete_docs(tables, _t(spark, sf_dir, "labels").where("toxic = 1"))
    counts = [left[k].agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k in ("docs", "chunks", "vectors")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@_register(
    "SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_name, s_acctbal FROM supplier"
)
def upsert_merge(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changed = table.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return reconcile.upsert(table.drop("c_mktsegment"), changed.unionByName(new), "c_custkey")


@_register("SELECT doc_id, CASE WHEN l.quality IS NOT NULL THEN 'q' || l.quality ELSE source END AS source, n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def touch_documents(spark, sf_dir):
    touched = _t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("source"))
    return reconcile.touch(_t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), touched, ["source"])


@_register("SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def scan_stats_largest(spark, sf_dir):
    return _t(spark, sf_dir, "documents").orderBy(F.col("n_chars").desc(), "doc_id").limit(20).select("doc_id", "n_chars", "source")


@_register("SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS bytes, max(n_chars) AS largest FROM documents GROUP BY ALL")
def scan_stats_totals(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.max("n_chars").alias("largest"))


# --- pages, blocks and lines ---------------------------------------------------------------------------------------


@_register(
    "WITH b AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS text FROM documents), k AS (SELECT *, substr(regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'), 1, 180) AS key FROM b WHERE trim(text) <> ''), "
    "n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM k GROUP BY doc_id), r AS (SELECT doc_id, key, count(DISTINCT page) AS df FROM k GROUP BY doc_id, key), "
    "gone AS (SELECT doc_id, key FROM r JOIN n USING (doc_id) WHERE df >= greatest(2, floor(0.05 * pages + 0.999)::BIGINT)) SELECT doc_id, count(*) AS kept FROM k ANTI JOIN gone USING (doc_id, key) GROUP BY doc_id"
)
def repeated_margin_removal(spark, sf_dir):
    blocks = _t(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text")).where(F.trim("text") != "")
    return pdf_blocks.without_margins(blocks, share=0.05).groupBy("doc_id").agg(F.count("*").alias("kept"))


@_register(
    "WITH x AS (SELECT p_brand, p_size::DOUBLE AS v, unnest(range(greatest(1, least(50, length(p_name) // 2)))) FROM part), m AS (SELECT p_brand, quantile_cont(v, 0.5) AS body FROM x GROUP BY p_brand) "
    "SELECT p_partkey, round(body, 6) AS body, CASE WHEN p_size >= 1.18 * body THEN 'heading' ELSE 'text' END AS kind FROM part JOIN m USING (p_brand)"
)
def weighted_median_classify(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    weight = F.greatest(F.lit(1), F.least(F.lit(50), F.floor(F.length("p_name") / 2).cast("int")))
    body = part.groupBy("p_brand").agg(F.percentile(F.col("p_size").cast("double"), F.lit(0.5), weight).alias("body"))
    return part.join(body, "p_brand").select("p_partkey", _r("body").alias("body"), F.when(F.col("p_size") >= 1.18 * F.col("body"), "heading").otherwise("text").alias("kind"))


@_register(
    "SELECT l_orderkey, round(min(l_quantity), 2) AS x0, round(min(l_extendedprice), 2) AS y0, round(max(l_quantity), 2) AS x1, round(max(l_extendedprice), 2) AS y1 FROM lineitem GROUP BY l_orderkey"
)
def bbox_union(spark, sf_dir):
    boxes = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_quantity", "l_extendedprice", "l_quantity", "l_extendedprice").alias("bbox"))
    return pdf_blocks.bbox_union(boxes, "l_orderkey").select("l_orderkey", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@_register("SELECT page_id, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))), 1, 256), ' ') AS imports FROM pages")
def imports_regex_distinct(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(F.array_sort(F.array_distinct(found)), 1, 256), " ").alias("imports"))


@_register(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), r AS (SELECT doc_id, n::INTEGER AS line, unnest(regexp_extract_all(line, '([A-Za-z]+)[.]', 1)) AS target FROM l) "
    "SELECT doc_id, line, lower(target) AS target_name_lc, count(*) AS hits FROM r GROUP BY ALL"
)
def refs_regex_lines(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    found = lines.select("doc_id", (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)[.]"), F.lit(1))).alias("target"))
    return found.groupBy("doc_id", "line", F.lower("target").alias("target_name_lc")).agg(F.count("*").alias("hits"))


@_register(
    """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, length(line) + 1 AS own FROM l),
t AS (SELECT doc_id, max(i) AS n, max(upto) - 1 AS chars FROM c GROUP BY doc_id),
w AS (SELECT doc_id, 0 AS part, 1 AS s, (SELECT coalesce(min(c.i), t.n) FROM c WHERE c.doc_id = t.doc_id AND c.upto >= 1536) AS e FROM t WHERE n > 2 AND chars > 1536
      UNION ALL SELECT w.doc_id, w.part + 1, greatest(w.s + 1, w.e - 1),
        (SELECT coalesce(min(c.i), t.n) FROM c WHERE c.doc_id = w.doc_id AND c.i >= greatest(w.s + 1, w.e - 1) AND c.upto - (SELECT d.upto - d.own FROM c d WHERE d.doc_id = w.doc_id AND d.i = greatest(w.s + 1, w.e - 1)) >= 1536)
      FROM w JOIN t USING (doc_id) WHERE w.e < t.n)
SELECT doc_id, part::INTEGER AS part, s::INTEGER AS line_start, e::INTEGER AS line_end FROM w UNION ALL SELECT doc_id, 0, 1, n::INTEGER FROM t WHERE n <= 2 OR chars <= 1536
"""
)
def line_window_chunks(spark, sf_dir):
    return chunks.window_lines(_t(spark, sf_dir, "documents"), "doc_id", "text", 1536, 2)


@_register(
    """
WITH RECURSIVE p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, greatest(1, length(text) // 4) AS own FROM conversations),
g AS (SELECT conv_id, i, 0 AS g, own AS size FROM p WHERE i = 1
      UNION ALL SELECT p.conv_id, p.i, CASE WHEN g.size + p.own <= 384 THEN g.g ELSE g.g + 1 END, CASE WHEN g.size + p.own <= 384 THEN g.size + p.own ELSE p.own END FROM g JOIN p ON p.conv_id = g.conv_id AND p.i = g.i + 1),
c AS (SELECT conv_id, g, trim(string_agg(text, chr(10) || chr(10) ORDER BY p.i), ' ' || chr(10)) AS text FROM g JOIN p USING (conv_id, i) GROUP BY conv_id, g),
m AS (SELECT conv_id, g, text, sum(CASE WHEN g = 0 OR length(text) >= 80 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY g) - 1 AS ord FROM c)
SELECT conv_id, ord::INTEGER AS ord, string_agg(text, chr(10) || chr(10) ORDER BY g) AS text FROM m GROUP BY conv_id, ord
"""
)
def paragraph_pack_chunks(spark, sf_dir):
    whole = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    texts = whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n").alias("text"))
    return chunks.chunk_texts(texts, "conv_id", "text").select("conv_id", "ord", "text")


# --- source files ----------------------------------------------------------------------------------------------------
# A file for each part: what stands on which line is known from how it is written, so SQL says what must be found without parsing it.

_CODE = (
    ("import os",), ("from app.store import load_", "k"), ("",), ("class Part", "k", ":"), ('    """About ', "name", '."""'), ("",), ("    def run_", "k", "(self, value):"), ("        # starts ", "name"),
    ("        return load_", "k", "(value)"), ("",), ("def main_", "k", "(path):"), ("    return os.path.exists(path)",),
)


def _code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = {"k": F.col("p_partkey").cast("string"), "name": F.col("p_name")}
    lines = [F.concat(*(value.get(x, F.lit(x)) for x in line)) for line in _CODE]
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("d"), value["k"]).alias("doc_id"), F.concat(F.lit("src/part_"), value["k"], F.lit(".py")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


_SYMBOLS_SQL = (
    "(SELECT 'd' || p_partkey AS doc_id, 'class' AS kind, 'Part' || p_partkey AS name, '' AS parent, 'class Part' || p_partkey || ':' AS signature, 'About ' || p_name || '.' AS docstring, 4 AS line_start, 6 AS line_end FROM part "
    "UNION ALL SELECT 'd' || p_partkey, 'function', 'run_' || p_partkey, 'Part' || p_partkey, 'def run_' || p_partkey || '(self, value):', 'starts ' || p_name, 7, 10 FROM part "
    "UNION ALL SELECT 'd' || p_partkey, 'function', 'main_' || p_partkey, '', 'def main_' || p_partkey || '(path):', '', 11, 12 FROM part)"
)


_QUALIFIED_SQL = "CASE WHEN parent = '' THEN name ELSE parent || '.' || name END"


@_register(f"SELECT doc_id, 'python' AS language, kind, name, parent, {_QUALIFIED_SQL} AS qualified_name, signature, docstring, line_start, line_end FROM {_SYMBOLS_SQL}")
def code_symbols(spark, sf_dir):
    found = extract.symbols(_code_files(spark, sf_dir))
    return found.select("doc_id", "language", "kind", "name", "parent", "qualified_name", "signature", "docstring", "line_start", "line_end")


@_register(
    "SELECT 'd' || p_partkey AS doc_id, 'import' AS ref_kind, 'os' AS target_name, 1 AS line, '' AS source FROM part UNION ALL SELECT 'd' || p_partkey, 'import', 'load_' || p_partkey, 2, '' FROM part "
    "UNION ALL SELECT 'd' || p_partkey, 'call', 'load_' || p_partkey, 9, 'run_' || p_partkey FROM part UNION ALL SELECT 'd' || p_partkey, 'call', 'exists', 12, 'main_' || p_partkey FROM part"
)
def code_references(spark, sf_dir):
    files = _code_files(spark, sf_dir)
    found = extract.symbols(files)
    names = found.select(F.col("id").alias("source_symbol_id"), F.col("name").alias("source"))
    return extract.references(files, found).join(names, "source_symbol_id", "left").select("doc_id", "ref_kind", "target_name", "line", F.coalesce("source", F.lit("")).alias("source"))


@_register("SELECT 'd' || p_partkey AS doc_id, 'app.store,load_' || p_partkey || ',os' AS imports FROM part")
def code_imports(spark, sf_dir):
    return _code_files(spark, sf_dir).select("doc_id", F.array_join(extract.imports_of(F.col("text")), ",").alias("imports"))


@_register(
    f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 + 2)::INTEGER AS ord, 'symbol' AS chunk_type, {_QUALIFIED_SQL} AS section, name AS symbol_name, line_start, line_end FROM {_SYMBOLS_SQL} "
    "UNION ALL SELECT 'd' || p_partkey, 1, 'imports', 'imports', '', 1, 2 FROM part UNION ALL SELECT 'd' || p_partkey, 0, 'file_summary', 'file summary', '', 1, 12 FROM part"
)
def code_chunks(spark, sf_dir):
    files = _code_files(spark, sf_dir)
    made = chunks.chunks(files, extract.symbols(files), Settings(file_summaries=True))
    return made.select("doc_id", "ord", "chunk_type", "section", "symbol_name", "line_start", "line_end")


# --- pages of PDF files -----------------------------------------------------------------------------------------------


@_register(
    "WITH b AS (SELECT *, p_size::DOUBLE AS v, (p_partkey % 10) / 10.0::DOUBLE AS bold, (p_partkey % 7) / 10.0::DOUBLE AS mono FROM part), x AS (SELECT p_brand, v, unnest(range(greatest(1, least(50, length(p_name) // 20)))) FROM b), "
    "m AS (SELECT p_brand, quantile_cont(v, 0.5) AS body FROM x GROUP BY p_brand) "
    "SELECT p_partkey, CASE WHEN length(p_name) <= 180 AND (v >= 1.18 * body OR (bold >= 0.65 AND v >= 0.98 * body)) THEN 'heading' WHEN mono >= 0.55 THEN 'code' ELSE 'text' END AS kind FROM b JOIN m USING (p_brand)"
)
def pdf_block_kinds(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    blocks = part.select(
        "p_partkey", F.col("p_brand").alias("doc_id"), F.col("p_name").alias("text"), F.col("p_size").cast("double").alias("font_size"), ((F.col("p_partkey") % 10) / 10.0).alias("bold_ratio"), ((F.col("p_partkey") % 7) / 10.0).alias("mono_ratio")
    )
    return pdf_blocks.classified(blocks).select("p_partkey", "kind")


@_register(
    "SELECT conv_id, (turn // 4)::BIGINT AS page, 0 AS ord, 'pdf_text' AS chunk_type, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, min(turn)::DOUBLE AS x0, max(turn)::DOUBLE AS x1 FROM conversations WHERE length(text) > 0 GROUP BY conv_id, turn // 4"
)
def pdf_page_chunks(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").where(F.length("text") > 0)
    at = F.col("turn").cast("double")
    blocks = turns.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).alias("page"), F.col("turn").cast("int").alias("ord"), F.lit("text").alias("kind"), "text", F.array(at, at, at, at).alias("bbox"))
    made = pdf_blocks.pdf_chunks(blocks, tokens=1 << 30)
    return made.select(F.col("doc_id").alias("conv_id"), "page", "ord", "chunk_type", "text", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(2)).alias("x1"))


@_register("SELECT conv_id AS doc_id, (turn // 3)::BIGINT AS page, max_by(role, turn) AS title FROM conversations GROUP BY ALL")
def pdf_page_titles(spark, sf_dir):
    outline = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 3).alias("page"), F.col("role").alias("title"), F.col("turn").alias("pos"))
    return pdf_blocks.page_titles(outline)


@_register(
    "WITH t AS (SELECT doc_id, replace(regexp_replace(text, '\\. ', '-' || chr(10), 'g'), chr(10), ' ' || chr(10) || chr(10) || chr(10)) || chr(10) || 'co-' || chr(10) || 'op' AS t FROM documents), "
    "a AS (SELECT doc_id, regexp_replace(t, '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g') AS t FROM t), b AS (SELECT doc_id, regexp_replace(t, '[ \\t]+\\n', chr(10), 'g') AS t FROM a) "
    "SELECT doc_id, md5(trim(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'))) AS cleaned FROM b"
)
def page_text_clean(spark, sf_dir):
    raw = F.concat(F.replace(F.regexp_replace("text", r"\. ", "-\n"), F.lit("\n"), F.lit(" \n\n\n")), F.lit("\nco-\nop"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(clean_page_text(raw)).alias("cleaned"))


# --- more of the index -------------------------------------------------------------------------------------------------


@_register(
    "WITH l AS (SELECT n_chars, source || '/' || doc_id AS path FROM documents ORDER BY n_chars DESC, path LIMIT 20) SELECT 'largest' AS what, path, n_chars AS size FROM l "
    "UNION ALL SELECT 'files', '', count(*) FROM documents UNION ALL SELECT 'bytes', '', sum(n_chars)::BIGINT FROM documents"
)
def scan_statistics_report(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("n_chars").alias("size_bytes"), F.concat_ws("/", "source", "doc_id").alias("path"))
    found = scan.scan_statistics(files, 20)
    rows = [("files", "", found["files"]), ("bytes", "", found["bytes"]), *(("largest", x["path"], x["size"]) for x in found["largest"])]
    return spark.createDataFrame(rows, "what string, path string, size long")


@_register("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT p_partkey + 100000000, min(p_name) FROM part GROUP BY 1")
def insert_ignored(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(_t(spark, sf_dir, "part").select((F.col("p_partkey") + 100_000_000).alias("id"), F.col("p_name").alias("name")))
    return reconcile.insert_or_ignore(table, rows, "id")


def _nation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("target_name_lc"))
    refs = _t(spark, sf_dir, "customer").join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return refs.select(F.col("c_custkey").alias("id"), "target_name_lc", F.col("c_mktsegment").alias("path"), F.col("c_custkey").alias("line"), (F.col("c_custkey") % 25).cast("string").alias("source_symbol_id"))


_ENGLISH_SQL = "lang = 'en'"
_REFS_TO_7 = "(SELECT c_custkey AS id, c_mktsegment AS path, c_custkey AS line, c_custkey % 25 AS source FROM customer WHERE c_nationkey = 7 ORDER BY path, line, id LIMIT 40)"


@_register(f"SELECT id, path, line FROM {_REFS_TO_7}")
def neighbors_references(spark, sf_dir):
    return navigation.neighbors(_nations_as_symbols(spark, sf_dir), _nation_refs(spark, sf_dir), 7)["references"].select("id", "path", "line")


@_register(f"SELECT r.id, path, n_name AS caller FROM {_REFS_TO_7} r JOIN nation ON n_nationkey = source")
def neighbors_callers(spark, sf_dir):
    return navigation.neighbors(_nations_as_symbols(spark, sf_dir), _nation_refs(spark, sf_dir), 7)["callers"].select("id", "path", "caller")


@_register(
    f"WITH w AS (SELECT doc_id::VARCHAR AS id, score FROM {bm25_sql('documents', 'doc_id', {'text': 1.0}, PHRASES, _ENGLISH_SQL)} x ORDER BY x.score DESC, id LIMIT 120), r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM w) "
    "SELECT id, round(0.38::DOUBLE / (60 + r), 6) AS score FROM r ORDER BY r LIMIT 8"
)
def document_search_keyword(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    held = docs.select("id", F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("path"), F.when(F.col("lang") == "en", "pdf_text").otherwise("text").alias("chunk_type"), F.lit(0).alias("ord"))
    index = _index(docs.select("id", "text"), sf_dir, "documents by text id", "id", ["text"])
    hits = documents.document_search(docs.select("doc_id"), held, docs, QUERY, [], mode="keyword", index=index)
    return hits.select("id", _r("score").alias("score"))


@_register()
def ann_topk_batch(spark, sf_dir):
    """The vectors whose id is divisible by 20 as queries, against inverted lists of all vectors. No SQL: a test measures its recall against the exact search."""
    vectors = _t(spark, sf_dir, "embeddings")
    centroids = ann.fit_centroids(vectors, max(4, round(vectors.count() ** 0.5)))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = ann.ivf_topk_many(ann.ivf_index(vectors, centroids), centroids, asked, 10)
    return found.select("query_id", "vec_id", _r("score").alias("score"), "rank")
