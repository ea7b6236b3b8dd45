"""Comparing a corpus with what is indexed, and making the next version of a table from the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(current: DataFrame, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, status): new, changed (another content hash), touched (the same content, other time or size), same, or missing.

    Both tables: id, content_hash, mtime_ns, size_bytes. Only these columns are read.
    """
    cols = ["content_hash", "mtime_ns", "size_bytes"]
    now, old = current.select(id_col, *(F.col(c).alias(f"n_{c}") for c in cols), F.lit(True).alias("n")), manifest.select(id_col, *(F.col(c).alias(f"o_{c}") for c in cols), F.lit(True).alias("o"))
    stat_same = (F.col("n_mtime_ns") == F.col("o_mtime_ns")) & (F.col("n_size_bytes") == F.col("o_size_bytes"))
    status = (
        F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "missing").when(F.col("n_content_hash") != F.col("o_content_hash"), "changed").when(stat_same, "same").otherwise("touched")
    )
    return now.join(old, id_col, "full").select(id_col, status.alias("status"))


def stat_changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (root, path, mtime_ns, size_bytes) that aren't in the manifest with the same time and size: only their content needs to be read."""
    same = ["root", "path", "mtime_ns", "size_bytes"]
    return files.join(manifest.select(*same), same, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """table with the rows of changes in place of those of the same key."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def touch(docs: DataFrame, touched: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """docs with some columns taken from touched where it has the id."""
    new = touched.select(id_col, *(F.col(c).alias(f"__{c}") for c in columns))
    both = docs.join(new, id_col, "left")
    return both.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in docs.columns))


def delete_docs(tables: dict[str, DataFrame], ids: DataFrame, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Each table without the rows of the documents in ids; vectors (chunk_id) go with their chunks."""
    gone = ids.select(id_col).distinct()
    out = {name: t.join(gone, id_col, "left_anti") for name, t in tables.items() if id_col in t.columns}
    if "vectors" in tables and "vectors" not in out:
        kept = out["chunks"].select(F.col("id").alias("chunk_id"))
        out["vectors"] = tables["vectors"].join(kept, "chunk_id", "left_semi")
    return out


def delete_missing(tables: dict[str, DataFrame], live: DataFrame, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Each table without the documents that aren't live."""
    return delete_docs(tables, tables["docs"].select(id_col).join(live.select(id_col), id_col, "left_anti"), id_col)


def vector_cache(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(embedding_hash, vector): what was embedded already, each hash once."""
    own = chunks.where("embedding_hash <> ''").select(F.col("id").alias("chunk_id"), "embedding_hash")
    return own.join(vectors.select("chunk_id", "vector"), "chunk_id").groupBy("embedding_hash").agg(F.min_by("vector", "chunk_id").alias("vector"))


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(docs, chunks, symbols, refs, vectors, pdf_chunks, pdf_documents) in one row."""
    pdf = tables["chunks"].where(F.startswith("chunk_type", F.lit("pdf_"))).agg(F.count("*").alias("pdf_chunks"), F.countDistinct("doc_id").alias("pdf_documents"))
    out = pdf
    for name in ("vectors", "refs", "symbols", "chunks", "docs"):
        out = tables[name].agg(F.count("*").alias(name)).join(F.broadcast(out))  # one row each
    return out


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> int:
    """Rows of child whose parent is missing: 0 in a sound index."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti").count()
