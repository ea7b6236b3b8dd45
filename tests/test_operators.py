"""Operators on small frames."""

import hashlib
import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunks, dense, documents, extract, fusion, lexical, navigation, pdf_blocks, reconcile
from tessera.settings import Settings

ROWS = [(1, "The quick brown fox", "a validate_token here"), (2, "Élan vital", "validate the token, validate token"), (3, "brown", "fox fox fox"), (4, "", "nothing to see")]


def test_bm25_agrees_with_a_full_text_engine(spark):
    df = spark.createDataFrame(ROWS, "id long, title string, body string")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, body, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into t(rowid, title, body) values (?, ?, ?)", ROWS)
    for query in ("fox", "validate_token", "elan", "brown fox token", "fox nothing vital"):
        phrases = T.query_phrases(query)
        match = " OR ".join('"' + " ".join(p) + '"' for p in phrases)
        want = {r[0]: -r[1] for r in con.execute("select rowid, bm25(t, 2.0, 1.0) from t where t match ?", (match,))}
        got = {r.id: r.score for r in lexical.bm25(df, "id", {"title": 2.0, "body": 1.0}, phrases).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), query
    assert lexical.bm25(df, "id", {"body": 1.0}, []).count() == 0


def test_postings_give_the_same_scores(spark):
    df = spark.createDataFrame(ROWS, "id long, title string, body string")
    index = lexical.postings(df, "id", ["title", "body"])
    stats = lexical.statistics(lexical.sizes(index, df, "id"))
    weights = {"title": 2.0, "body": 1.0}
    for query in ("fox", "validate_token", "brown-fox token", "fox nothing vital", "fox.fox"):
        phrases = T.query_phrases(query)
        for scope in (None, F.col("id") > 1):
            scoped = None if scope is None else df.where(scope)
            a = {r.id: r.score for r in lexical.bm25_from_postings(index, stats, "id", phrases, weights, scoped).collect()}
            b = {r.id: r.score for r in lexical.bm25(df, "id", weights, phrases, scope).collect()}
            assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a), query
    assert lexical.bm25_from_postings(index, stats, "id", [], weights).count() == 0


def test_dense_plans_and_batches(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    top = dense.dense_topk(df, list(vectors[3]), 5)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    assert [r.vec_id for r in top.collect()] == np.argsort(-(vectors @ vectors[3]), kind="stable")[:5].tolist()
    asked = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in (3, 7)], "query_id long, vector array<double>")
    got = dense.dense_topk_many(df, asked, 5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 3] == [r.vec_id for r in top.collect()]
    assert dense.dense_topk_many(df, asked.limit(0), 5).count() == 0


def test_queries_beyond_a_block_are_all_answered(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in dense.dense_topk_many(df, asked, 4, most_queries=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {i: np.argsort(-(vectors @ v), kind="stable")[:4].tolist() for i, v in enumerate(vectors)}


def _embedded(texts):
    out = {}
    for i, t in texts:
        own = out.setdefault(i, [0] * 384)
        t = f"  {(t or '').lower()}  "
        for j in range(len(t) - 2):
            h = int(hashlib.md5(t[j : j + 3].encode()).hexdigest()[:8], 16)
            own[h % 384] += -1 if h >> 31 else 1
    return {(i, k): v / sum(x * x for x in own) ** 0.5 for i, own in out.items() for k, v in enumerate(own) if v}


def test_documents_are_hash_embedded(spark, tmp_path):
    from tessera.plans import catalog

    rng = np.random.default_rng(2)
    long = " ".join(f"Wort{x} \U0001f600é" for x in rng.integers(0, 5000, 20_000))
    texts = [(1, None), (2, ""), (3, "a"), (4, long), (5, "same"), (6, "same"), (7, "two rows"), (7, "of one id"), (8, "日本 \n x")]
    for rows in (texts, [x for x in texts if x[0] != 7]):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = {(r.doc_id, r.slot): r.value for r in catalog.queries()["hash_embed_trigram_documents"](spark, str(tmp_path)).collect()}
        want = _embedded(rows)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_texts_are_embedded_once(spark):
    rows = spark.createDataFrame([(1, "h1", "a"), (2, "h1", "a"), (3, "h2", "b")], "id long, embedding_hash string, embedding_text string")
    known = spark.createDataFrame([("h2", [9.0, 9.0])], "embedding_hash string, vector array<float>")
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        if len(texts) > 1:
            raise MemoryError
        return np.ones((len(texts), 2))

    out = {r.id: r.vector for r in dense.embed_once(rows, known, embed, 2).collect()}
    assert out[1] == out[2] and out[3] == [9.0, 9.0] and seen.value == 1


def test_fusion_orders_ties_by_source_and_rank(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "id string, score double")
    b = spark.createDataFrame([("y", 5.0), ("z", 4.0)], "id string, score double")
    got = fusion.fuse({"a": a, "b": b}, {"a": 1.0, "b": 1.0}, "id", 10).collect()
    assert [r.id for r in got] == ["y", "x", "z"]
    assert abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12 and got[0].sources == ["a", "b"]


def test_tiers_and_references(spark):
    symbols = spark.createDataFrame([("1", "run", "app.run", "function"), ("2", "Run", "Run", "class"), ("3", "prerunner", "x.prerunner", "function"), ("4", "other", "run.other", "function")], "id string, name string, qualified_name string, kind string")
    got = {r.id: r.score for r in navigation.symbol_tiers(symbols, "run", 10, path_col=None).collect()}
    assert got["1"] == 100 and got["2"] == 100 and got["3"] == 40 and 40 <= got["4"] < 100
    refs = spark.createDataFrame([("1", "run", "a", 3), ("2", "runner", "a", 1)], "id string, target_name_lc string, path string, line int")
    assert [r.id for r in navigation.references(refs, "x.Run", 5).collect()] == ["1"]
    assert [r.id for r in navigation.references(refs, "unner", 5).collect()] == ["2"]
    assert navigation.references(refs, "none", 5).count() == 0


def test_enclosing_takes_the_innermost(spark):
    spans = spark.createDataFrame([("d", "outer", 1, 20), ("d", "inner", 5, 9), ("d", "same", 5, 12)], "doc_id string, id string, line_start int, line_end int")
    points = spark.createDataFrame([("d", 6), ("d", 11), ("d", 15), ("d", 30), ("e", 6)], "doc_id string, line int")
    got = {(r.doc_id, r.line): r.enclosing_id for r in navigation.enclosing(points, spans, "doc_id").collect()}
    assert got == {("d", 6): "inner", ("d", 11): "same", ("d", 15): "outer", ("d", 30): None, ("e", 6): None}


def test_reconciliation(spark):
    cols = "doc_id string, content_hash string, mtime_ns long, size_bytes long"
    now = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 2, 1), ("c", "3", 1, 1), ("n", "9", 1, 1)], cols)
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1), ("c", "0", 1, 1), ("m", "9", 1, 1)], cols)
    assert {r.doc_id: r.status for r in reconcile.manifest_diff(now, old).collect()} == {"a": "same", "b": "touched", "c": "changed", "n": "new", "m": "missing"}
    assert {r.mtime_ns for r in reconcile.touch(old, now.where("doc_id = 'b'"), ["mtime_ns"]).where("doc_id = 'b'").collect()} == {2}
    assert reconcile.insert_or_ignore(old, now, "doc_id").count() == 5
    left = reconcile.delete_missing({"docs": old, "chunks": old.withColumnRenamed("content_hash", "id").select("doc_id", "id")}, now)
    assert {r.doc_id for r in left["chunks"].collect()} == {"a", "b", "c"}


def test_margins_kinds_tables_and_chunks(spark):
    rows = []
    for page in range(1, 5):
        rows += [("d", page, 0, f"Report {page}", [0.0, 0.0, 9.0, 1.0], 9.0, 0.0, 0.0), ("d", page, 1, f"Heading {'abcd'[page - 1]}", [0.0, 2.0, 9.0, 3.0], 20.0, 0.0, 0.0)]
        rows += [("d", page, 2 + i, f"body {'pqrs'[page - 1]} {i} " + "word " * 30, [0.0, 4.0 + i, 9.0, 5.0 + i], 10.0, 0.0, 0.9 if i == 1 else 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, bbox array<double>, font_size double, bold_ratio double, mono_ratio double")
    kept = pdf_blocks.without_margins(df)
    assert kept.where("text like 'Report%'").count() == 0 and kept.count() == 16
    kinds = pdf_blocks.classified(kept)
    assert {r.kind for r in kinds.where("text like 'Heading%'").collect()} == {"heading"} and kinds.where("kind = 'code'").count() == 4
    made = pdf_blocks.pdf_chunks(kinds, tokens=80, overlap=10).orderBy("page", "ord").collect()
    assert made[0].section == "Heading a" and all("Heading" not in c.text for c in made)
    assert {c.page for c in made} == {1, 2, 3, 4} and all(f"body p {i}" in " ".join(c.text for c in made) for i in range(3))
    docs = spark.createDataFrame([("d", "r.pdf")], "doc_id string, path string")
    rows = chunks.pdf_document_chunks(docs, df, Settings(pdf_chunk_tokens=80, pdf_chunk_overlap=10)).orderBy("ord").collect()
    assert [r.page for r in rows] == sorted(r.page for r in rows) and len({r.id for r in rows}) == len(rows) == len(made)
    table = spark.range(1).select(pdf_blocks.table_markdown(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1")))).alias("t")).first().t
    assert table == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_document_search_stays_in_its_family(spark):
    docs = spark.createDataFrame([("d1", "a/manual.pdf", "Manual"), ("d2", "b.py", "b")], "doc_id string, path string, title string")
    held = spark.createDataFrame([("c1", "d1", "a/manual.pdf", "Manual", "s", "pump pressure", "pdf_text", 0), ("c2", "d2", "b.py", "b", "s", "pump pressure", "symbol", 0)], "id string, doc_id string, path string, title string, section string, text string, chunk_type string, ord int")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [1.0, 0.0])], "chunk_id string, vector array<double>")
    for post in (False, True):
        got = documents.document_search(docs, held, vectors, "manual", [1.0, 0.0], 5, postfilter=post).collect()
        assert [r.id for r in got] == ["c1"] and got[0].sources == ["dense", "fts", "path"]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.go", "package x\nfunc (r *T) Run() {\n}\ntype T struct {\n}\n", {("Run", "function"), ("T", "type")}),
        ("a.rs", "pub fn go() {\n}\nimpl Foo {\n}\n", {("go", "function"), ("Foo", "impl")}),
        ("a.ts", "export class A {\n}\nexport interface B {\n}\n", {("A", "class"), ("B", "interface")}),
        ("a.java", "public class A {\n  public int run(int x) {\n  }\n}\n", {("A", "class"), ("run", "function")}),
        ("k.cu", "__global__ void kernel(int* x) {\n}\n", {("kernel", "function")}),
        ("a.md", "class A", set()),
    ],
)
def test_symbols_by_language(spark, path, text, want):
    files = spark.createDataFrame([("d", path, text)], "doc_id string, path string, text string")
    assert {(r.name, r.kind) for r in extract.symbols(files).collect()} == want


def test_imports_languages_and_text_helpers(spark):
    row = spark.createDataFrame([("import os\nfrom a.b import c, d\nimport x from './y'\n#include <z.h>\nuse q::r",)], "t string").select(extract.imports_of(F.col("t")).alias("x")).first()
    assert {"os", "a.b", "c, d", "./y", "z.h", "q::r"} <= set(row.x)
    names = spark.createDataFrame([("a/b.py",), ("Dockerfile",), ("x.unknown",), ("a.d/none",)], "p string").select(extract.language_of(F.col("p")).alias("l")).collect()
    assert [r.l for r in names] == ["python", "dockerfile", "", ""]
    one = spark.range(1)
    assert one.select(T.clean_page_text(F.lit("exam-\nple  \n\n\n\nx")).alias("x")).first().x == "example\n\nx"
    assert one.select(T.snippet(F.lit("a" * 800)).alias("x")).first().x == "a" * 700 + "…"
    assert one.select(T.fetch_text(F.lit("ab"), 1).alias("x")).first().x == "a\n...[truncated]"
    assert one.select(T.is_binary(F.lit(b"a\x00")).alias("a"), T.is_binary(F.lit(b"plain")).alias("b"), T.is_binary(F.lit(b"")).alias("c")).first()[0:3] == (True, False, False)
    assert one.select(T.stable_id("a", F.lit("b")).alias("x")).first().x != one.select(T.stable_id("ab", F.lit("")).alias("x")).first().x


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#", max_size=400), st.integers(1, 40))
def test_packing_keeps_every_character(text, target):
    spans = chunks.packed_spans(text, target)
    assert all(a < b for a, b in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
    covered = "".join(text[a:b] for a, b in spans)
    assert covered.replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=30), max_size=60), st.integers(10, 200), st.integers(0, 5))
def test_windows_cover_every_line(lines, most, overlap):
    spans = chunks.line_windows(lines, most, overlap)
    assert sorted({i for a, b in spans for i in range(a, b + 1)}) == list(range(len(lines)))


def test_tiny_last_chunk_joins_the_one_before():
    made = chunks.text_chunks("# A\n\n" + "x" * 2000 + "\n\n" + "y" * 2000 + "\n\nend", Settings())
    assert made[-1]["text"].endswith("end") and made[0]["line_start"] == 1
    assert chunks.text_chunks("# A\n\n" + "x" * 2000 + "\n\n" + "y" * 2000, Settings())[-1]["section"] == "A"


def test_globs():
    import re

    assert re.match(T.glob_regex("**/*.py"), "a/b/c.py") and not re.match(T.glob_regex("**/*.py"), "c.py")
    assert re.match(T.glob_regex("id_rsa.*"), "id_rsa.pub") and not re.match(T.glob_regex("[!a].x"), "a.x")


def test_inverted_lists_find_most_neighbours(spark, sf, tmp_path):
    from tessera.operators import ann

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    centroids = ann.fit_centroids(vectors, 16)
    ann.ivf_index(vectors, centroids).write.partitionBy("list").parquet(str(tmp_path / "ivf"))
    index = spark.read.parquet(str(tmp_path / "ivf"))
    assert index.count() == vectors.count()
    found = total = 0
    for r in vectors.where("vec_id < 100").orderBy("vec_id").limit(12).collect():
        query = list(r.embedding)
        want = {x.vec_id for x in dense.dense_topk(vectors, query, 10).collect()}
        plan = ann.ivf_topk(index, centroids, query, 10, probes=10)
        found += len(want & {x.vec_id for x in plan.collect()})
        total += 10
    assert found / total >= 0.9
    assert "PartitionFilters: [list" in plan._jdf.queryExecution().executedPlan().toString()


def test_plans_push_filters_and_prune_columns(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = pages.where(T.path_prefix(F.col("url"), "http://th", strict=True)).select("page_id")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url" in plan and "html" not in plan.split("ReadSchema")[1]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = lexical.bm25(docs, "doc_id", {"text": 1.0}, [["the"], ["license"]])
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan and plan.count("regexp_extract_all") <= 4


def test_blocks_of_a_page_in_dictionary_form():
    from tessera.sources.pdf import page_blocks

    span = lambda text, **k: {"text": text, "size": 12.0, "font": "Times", "flags": 0} | k
    raw = {"blocks": [{"bbox": (0, 1, 2.004, 3), "lines": [{"spans": [span("Bold words", font="Times-Bold", size=20.0)]}, {"spans": [span("plain")]}]}, {"lines": [{"spans": [span("  ")]}]}, {"bbox": (0, 0, 1, 1), "lines": [{"spans": [span("x = 1", font="Courier")]}]}]}
    first, second = page_blocks(raw)
    assert first["text"] == "Bold words\nplain" and first["bbox"] == [0.0, 1.0, 2.0, 3.0] and first["font_size"] == 16.0 and first["bold_ratio"] == 10 / 15
    assert second["mono_ratio"] == 1.0 and second["bold_ratio"] == 0.0
