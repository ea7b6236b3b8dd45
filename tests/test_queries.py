"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, found.fetchall())


def test_recall_of_the_approximate_search(spark, sf):
    """Every vector whose id is divisible by 20 as a query, against the exact search over all vectors."""
    from tessera.operators import dense

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    exact = {(r.query_id, r.vec_id) for r in dense.dense_topk_many(vectors, asked, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in catalog.queries()["ann_topk_batch"](spark, sf).collect()}
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9
