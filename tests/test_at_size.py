"""What small regular tables don't show: missing and repeated rows, ties, tables of several parts."""

from functools import reduce
from operator import add

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import ann, chunks, extract, lexical, navigation
from tessera.plans import catalog

NO_SYMBOLS = lambda rows: rows.sparkSession.createDataFrame([], "doc_id string, id string, kind string, name string, qualified_name string, parent string, signature string, text string, line_start int")


def test_chunks_around_a_place_that_has_none(spark, tmp_path):
    turns = [(3, t, "user", f"turn {t}") for t in (0, 1, 3, 3, 4)] + [(4, 2, "user", "other")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["adjacent_chunks"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["adjacent_chunks"](spark, str(tmp_path)).collect()]
    assert got == sorted(want) == [("3:1", 1), ("3:3", 3), ("3:3", 3)]


def test_lists_are_searched_by_products_in_bounded_blocks(spark, monkeypatch):
    """Against the sums over the lists that a query looks at, with many equal vectors, string ids, and more queries than a block holds."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:300] = x[7]
    vectors = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 400, 20)], "query_id long, vector array<float>")
    centroids = ann.fit_centroids(vectors, 12)
    index = ann.ivf_index(vectors, centroids)
    own = {r.vec_id: r["list"] for r in index.collect()}
    want = {}
    for i in range(0, 400, 20):
        looks = set(np.argsort(-(x[i] @ centroids.T), kind="stable")[:5].tolist())
        score = lambda j: reduce(add, (float(a) * float(b) for a, b in zip(x[i], x[j], strict=True)), 0.0)  # noqa: B023, E731
        want[i] = sorted(((-score(j), f"v{j:03}") for j in range(400) if own[f"v{j:03}"] in looks))[:10]
    for most in (10_000, 7):
        monkeypatch.setattr(ann, "QUERIES", most)
        monkeypatch.setattr(ann, "SCORES", 100)
        found = ann.ivf_topk_many(index, centroids, asked, 10, probes=5)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # a query is not copied for each of its lists


def test_postings_are_made_without_a_shuffle_of_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TOKENS", 5)
    rows = [(1, "a", "b a Élan b", "x"), (2, "b", None, "x y x"), (3, "c", "", ""), (4, "d", "a " * 9, "a"), (5, "e", None, None)]
    df = spark.createDataFrame(rows, "id long, doc string, title string, body string").repartition(2)
    index = lexical.postings(df, "id", ["title", "body"], ["doc"])
    want = {}
    for i, doc, *texts in rows:
        toks = [(t or "").lower().replace("é", "e").split() for t in texts]
        for c, own in zip(("title", "body"), toks, strict=True):
            for at, t in enumerate(own):
                want.setdefault((t, i, doc, c, sum(map(len, toks))), []).append(at)
    got = {(r.term, r.id, r.doc, r.column, r["size"]): (r.hits, r.positions) for r in index.collect()}
    assert got == {k: (len(v), v) for k, v in want.items()} and index.count() == len(want)
    assert "hashpartitioning(term" not in index._jdf.queryExecution().executedPlan().toString()
    assert lexical.postings(df.limit(0), "id", ["title", "body"]).count() == 0


def test_copies_have_equal_scores(spark):
    """Ties are broken by id, so copies must not differ in the last digits by the order in which their phrases were summed."""
    words = "ash birch cedar elm fir hazel larch maple oak pine".split()
    texts = [" ".join(words[j] for j in range(10) if (i * 7 + j * 3) % (j + 2) == 0) for i in range(40)]
    df = spark.createDataFrame([(i, texts[i % 40]) for i in range(4000)], "id long, text string").repartition(7)
    index = lexical.postings(df, "id", ["text"])
    scored = lexical.bm25_from_postings(index, lexical.statistics(lexical.sizes(index, df, "id")), "id", [[w] for w in words], {"text": 1.0})
    of = {}
    for r in scored.collect():
        of.setdefault(texts[r.id % 40], set()).add(r.score)
    assert all(len(v) == 1 for v in of.values())


@pytest.mark.parametrize("make", [lambda r: chunks.chunk_texts(r, "id", "text"), lambda r: chunks.window_lines(r, "id", "text"), lambda r: chunks.chunks(r.selectExpr("cast(id as string) doc_id", "'a.txt' path", "text"), NO_SYMBOLS(r))])
def test_chunks_hold_few_rows_as_objects(spark, monkeypatch, make):
    """An Arrow batch has 10,000 rows once a table is large; the most that is made at once must not follow it."""
    rows = spark.range(500).selectExpr("id", "'one line' text").coalesce(1)
    handed = []

    def kept(self, f, schema):
        batch = pa.RecordBatch.from_pylist([{"id": i, "text": "one line", "doc_id": str(i), "path": "a.txt", "language": "", "symbols": None} for i in range(500)])
        handed.extend(b.num_rows for b in f([batch.rename_columns([{'text': '__text'}.get(c, c) if '__text' in self.columns else c for c in batch.schema.names]).select(self.columns)]))
        return plain_map(self, f, schema)

    plain_map = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", kept)
    assert make(rows).count() == 500 and sum(handed) == 500 and max(handed) <= 64


def test_points_pass_the_sweep_once(spark, monkeypatch):
    """Repeated points, points that are nowhere and columns of any type come through the sweep itself, in as many tasks as are asked for."""
    spans = spark.createDataFrame([("d", 1, 1, 20), ("d", 2, 5, 9), (None, 3, 1, 9), ("e", 4, None, 9), ("e", 5, 1, None)], "doc_id string, id int, line_start int, line_end int")
    rows = [("d", 6, ["x"]), ("d", 6, ["x"]), ("d", 30, None), ("d", None, ["y"]), (None, 6, ["z"]), ("e", 6, [])]
    found = navigation.enclosing(spark.createDataFrame(rows, "doc_id string, line int, tags array<string>"), spans, "doc_id", parts=3)
    got = [(r.doc_id, r.line, r.tags, r.enclosing_id) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((*r, 2 if r[:2] == ("d", 6) else None) for r in rows), key=repr)
    assert found.rdd.getNumPartitions() == 3 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([(f"d{i}", "a.py", f"def f{i}():\n    g()") for i in range(60)], "doc_id string, path string, text string")
    monkeypatch.setattr(extract, "FILES", 5)
    own = extract.symbols(files)
    assert own.rdd.getNumPartitions() == 12 and extract.references(files, own).rdd.getNumPartitions() == 12
