"""The engine's interface: building and updating an index, and the fixed read operations on it."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fetch_text, path_prefix, query_phrases, stable_id
from tessera.operators import chunks as chunk_ops
from tessera.operators import dense, documents, extract, fusion, lexical, navigation, reconcile
from tessera.settings import Settings
from tessera.sources import pdf, scan
from tessera.sources.snapshot import SCHEMA_VERSION, SnapshotStore

MODES = ("auto", "code", "hybrid", "semantic", "keyword", "symbol")


class Engine:
    """embed: texts -> array (n, dim), called on executors; without it a hash of character trigrams is used."""

    def __init__(self, spark: SparkSession, store: str, roots: list[str], settings: Settings | None = None, embed=None, dim: int | None = None):
        self.spark, self.roots, self.settings = spark, roots, settings or Settings()
        self.store = SnapshotStore(spark, store)
        self.embed, self.dim = embed or hash_embedder(dim or self.settings.embedding_dim), dim or self.settings.embedding_dim
        self._cache: dict = {}

    # --- writing -------------------------------------------------------------------------------------------

    def reindex(self, force: bool = False, paths: list[str] | None = None) -> dict:
        """Brings the index up to date: all of it, or the asked paths. Unchanged documents keep their rows, and texts that were embedded before keep their vectors."""
        began = time.time()
        with self.store.writing(self.settings.fingerprint()):
            current = self.store.current()
            # an index of other settings is built anew
            same = current and current["fingerprint"] == self.settings.fingerprint() and current["schema_version"] == SCHEMA_VERSION and current["buckets"] == self.store.buckets
            old = self.store.tables() if same and not force else {}
            if paths and current and not old and not force:
                paths = None  # asked paths alone would leave the rest in the old form
            files = scan.list_files(self.spark, self.roots, self.settings)
            targets = scan.resolve_targets(self.roots, paths, self.settings) if paths else None
            if targets:
                asked = ["file:" + p for p in targets.files]
                files = files.where(F.col("uri").isin(asked) | reduce(lambda a, b: a | b, (F.startswith("uri", F.lit(f"file:{d}/")) for d in targets.directories), F.lit(False)))
            if old:
                files_to_read = reconcile.stat_changed(files, old["docs"])
            else:
                files_to_read = files
            docs = scan.read_documents(self.spark, files_to_read, self.roots).persist()
            if old:
                status = reconcile.manifest_diff(docs, old["docs"])
                changed = docs.join(status.where("status in ('new', 'changed')"), "doc_id", "left_semi")
                touched = docs.join(status.where("status = 'touched'"), "doc_id", "left_semi")
            else:
                changed, touched = docs, None
            found = extract.symbols(changed)
            refs = extract.references(changed, found)
            made = chunk_ops.chunks(changed, found, self.settings)
            pdfs, pdf_made = self._pdf_chunks(files_to_read)
            if pdfs is not None:
                changed, made = changed.drop("text").unionByName(pdfs).withColumn("text", F.lit("")), made.unionByName(pdf_made)
            found, made = found.persist(), made.persist()  # each is read for several tables
            known = reconcile.vector_cache(old["chunks"], old["vectors"]) if old else None
            vectors = dense.embed_once(made.select(F.col("id").alias("chunk_id"), "doc_id", "embedding_hash", "embedding_text"), known.select("embedding_hash", "vector") if known is not None else None, self.embed, self.dim)
            new = {"docs": changed.drop("text"), "chunks": made.drop("embedding_text"), "symbols": found, "refs": refs, "vectors": vectors.select("chunk_id", "doc_id", "vector")}
            new |= index_tables(new["chunks"], found)
            buckets = None
            if old:
                live = files.select(F.col("root"), F.col("path"))
                if targets:
                    root_of = [(r, p[len(r) :].lstrip("/")) for p in targets.missing for r in map(str, self.roots) if p.startswith(r)]
                    gone = old["docs"].join(self.spark.createDataFrame(root_of, "root string, path string"), ["root", "path"], "left_semi").select("doc_id") if root_of else old["docs"].select("doc_id").limit(0)
                else:
                    gone = old["docs"].join(live, ["root", "path"], "left_anti").select("doc_id")
                gone = gone.unionByName(changed.select("doc_id")).persist()
                # only the buckets of documents that go, come or were touched are read and written
                buckets = self.store.buckets_of(gone.unionByName(touched.select("doc_id")))
                kept = reconcile.delete_docs(self.store.tables(buckets=buckets), gone)
                kept["docs"] = reconcile.touch(kept["docs"], touched, ["mtime_ns", "size_bytes"])
                new = {name: kept[name].unionByName(df) for name, df in new.items()}
            version = self.store.version() if buckets == [] else self.store.publish(new, self.settings.fingerprint(), buckets)
            self.store.drop_old()
            for held in (docs, found, made):
                held.unpersist()
        self._cache.clear()
        counts = reconcile.statistics(self.store.tables(version)).first().asDict()
        return {"ok": True, "version": version, "seconds": round(time.time() - began, 3)} | counts

    def _pdf_chunks(self, files: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows of documents and chunks of the PDF files, where the library that reads them is there and there are any."""
        if not pdf.available():
            return None, None
        own = files.where(F.lower("path").endswith(".pdf"))
        if own.isEmpty():
            return None, None
        docs = own.select(stable_id(F.col("root"), F.col("path")).alias("doc_id"), "root", "path", F.element_at(F.split("path", "/"), -1).alias("title"), "uri", "size_bytes", "mtime_ns")
        content = reduce(DataFrame.unionByName, (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(scan._root_uri(r)).select(F.col("path").alias("uri"), "content") for r in self.roots))
        held = docs.join(content, "uri")
        blocks = pdf.read_pdf_blocks(held, self.settings).where("error = ''").join(docs.select("uri", "doc_id"), "uri")
        rows = held.select("doc_id", "root", "path", "title", F.sha2("content", 256).alias("content_hash"), "size_bytes", "mtime_ns")
        return rows, chunk_ops.pdf_document_chunks(docs, blocks, self.settings)

    # --- reading -------------------------------------------------------------------------------------------

    def _tables(self) -> dict[str, DataFrame]:
        return self.store.tables(self.store.check())

    def _index(self, tables: dict[str, DataFrame], of: str) -> tuple[DataFrame, DataFrame]:
        """The postings of chunks or symbols, and their statistics."""
        return tables[f"{of}_postings"], lexical.statistics(tables[f"{of}_sizes"])

    def optimise(self) -> dict:
        """All tables in sorted files of good size; older snapshots go."""
        with self.store.writing(self.settings.fingerprint()):
            version = self.store.optimise()
            self.store.drop_old(1)
        self._cache.clear()
        return {"ok": True, "version": version}

    def query_vector(self, query: str) -> list[float]:
        v = self.embed([query])[0]
        n = max(float((v * v).sum()) ** 0.5, 1e-12)
        return [float(x) / n for x in v]

    def code_search(self, query: str, top_k: int | None = None, mode: str = "auto", prefix: str | None = None, include_text: bool = False) -> DataFrame:
        """The best chunks for a query: by symbols and paths, vectors and words, fused by their ranks."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        s, t, k = self.settings, self._tables(), self.settings.top_k(top_k)
        mode = "code" if mode == "auto" and query else mode
        under = path_prefix(F.col("path"), prefix)
        lists: dict[str, DataFrame] = {}
        exact = False
        if mode in ("code", "hybrid", "symbol"):
            hits = navigation.symbol_tiers(t["symbols"], query, s.candidate_k, under, index=self._index(t, "symbol"))
            best = hits.limit(1).collect()
            exact = s.exact_symbol_fast_path and bool(best) and best[0]["score"] >= navigation.EXACT and bool(re.match(navigation.IDENTIFIER, query.strip()))
            lists["symbol"] = navigation.chunks_for_symbols(t["chunks"], hits)
            if mode != "symbol" or not best:
                paths = navigation.path_search(t["docs"].where(under), query, s.candidate_k).select("doc_id", (1.0 / (1 + F.length("path"))).alias("score"))
                lists["path"] = navigation.chunks_for_docs(t["chunks"], paths)
        if mode in ("code", "hybrid", "semantic") and not exact:
            vectors = t["vectors"] if not s.strict_prefix or not prefix else t["vectors"].join(t["chunks"].where(under).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
            lists["dense"] = dense.dense_topk(vectors, self.query_vector(query), s.candidate_k, "chunk_id", "vector").withColumnRenamed("chunk_id", "id")
        if mode in ("code", "hybrid", "keyword"):
            hits = lexical.bm25_from_postings(*self._index(t, "chunk"), "id", query_phrases(query), navigation.CHUNK_WEIGHTS, t["chunks"].where(under) if prefix else None)
            lists["fts"] = lexical.top(hits, "id", s.candidate_k)
        weights = {"symbol": s.symbol_weight, "path": s.path_weight, "dense": s.dense_weight, "fts": s.fts_weight}
        fused = fusion.fuse(lists, weights, "id", k, s.rrf_k, {"symbol": s.symbol_bonus})
        return navigation.packed_hits(fused.select("id", "score"), t["chunks"], include_text, s.snippet_chars)

    def search(self, query: str, **options) -> list[dict]:
        """code_search's rows, kept for each version of the index and set of arguments."""
        key = (self.store.check(), query, tuple(sorted(options.items())))
        if key not in self._cache:
            if len(self._cache) >= 1024:
                self._cache.pop(next(iter(self._cache)))
            self._cache[key] = [r.asDict(True) for r in self.code_search(query, **options).collect()]
        return [dict(r) for r in self._cache[key]]

    def document_search(self, query: str, top_k: int | None = None, mode: str = "hybrid", prefix: str | None = None, include_text: bool = False, postfilter: bool = False) -> DataFrame:
        """The best chunks of PDF documents."""
        t = self._tables()
        vector = self.query_vector(query) if mode != "keyword" else []
        hits = documents.document_search(t["docs"], t["chunks"], t["vectors"], query, vector, top_k, mode, prefix, settings=self.settings, postfilter=postfilter, index=self._index(t, "chunk"))
        return navigation.packed_hits(hits.select("id", "score"), t["chunks"], include_text, self.settings.snippet_chars)

    def document_outline(self, path_or_id: str, limit: int = 500) -> list[dict]:
        t = self._tables()
        doc = navigation.find_document(t["docs"], t["chunks"], path_or_id).first()
        if doc is None:
            raise KeyError(path_or_id)
        return [r.asDict() for r in navigation.outline(t["chunks"], doc.doc_id, limit).collect()]

    def find_symbol(self, name: str, kind: str | None = None, prefix: str | None = None, limit: int | None = None) -> DataFrame:
        t = self._tables()
        where = path_prefix(F.col("path"), prefix) & (F.col("kind") == kind if kind else F.lit(True))
        hits = navigation.symbol_tiers(t["symbols"], name, limit or self.settings.default_top_k, where, index=self._index(t, "symbol"))
        return t["symbols"].join(F.broadcast(hits), "id").withColumn("uri", F.concat(F.lit("symbol://"), F.col("id"))).orderBy(F.col("score").desc(), "line_start", "id")

    def mentions(self, name: str, prefix: str | None = None, limit: int | None = None) -> DataFrame:
        """Chunks with the words of a name: what there is when no reference has it."""
        t = self._tables()
        scoped = t["chunks"].where(path_prefix(F.col("path"), prefix)) if prefix else None
        hits = lexical.bm25_from_postings(*self._index(t, "chunk"), "id", query_phrases(name), {"text": 1.0}, scoped)
        return navigation.packed_hits(lexical.top(hits, "id", limit or self.settings.reference_limit), t["chunks"], chars=self.settings.snippet_chars)

    def references(self, name: str, prefix: str | None = None, limit: int | None = None) -> DataFrame:
        n = max(1, min(limit or self.settings.reference_limit, 4 * self.settings.reference_limit))
        return navigation.references(self._tables()["refs"], name, n, path_prefix(F.col("path"), prefix))

    def neighbors(self, symbol: str, limit: int = 40) -> dict[str, DataFrame]:
        t = self._tables()
        row = self.find_symbol(symbol, limit=1).select("id").first()
        if row is None:
            raise KeyError(symbol)
        return navigation.neighbors(t["symbols"], t["refs"], row[0], limit)

    def repo_map(self, prefix: str | None = None, limit: int | None = None) -> DataFrame:
        t = self._tables()
        n = max(1, min(limit or self.settings.map_limit, 3 * self.settings.map_limit))
        return navigation.repo_map(t["docs"], t["symbols"], n, where=path_prefix(F.col("path"), prefix))

    def fetch(self, uri: str, context: int = 1) -> dict:
        """The text of a chunk (rag://doc#chunk=id, or an id) with the chunks around it, or of a symbol (symbol://id, or an id)."""
        t, n = self._tables(), self.settings.fetch_chars
        plain = uri.split("#chunk=")[-1].removeprefix("symbol://").removeprefix("rag://")
        if not uri.startswith("rag://"):
            symbol = t["symbols"].where(F.col("id") == plain).select("id", "path", "qualified_name", fetch_text(F.col("text"), n).alias("text"), "line_start", "line_end").first()
            if symbol:
                return symbol.asDict()
        chunk = t["chunks"].where(F.col("id") == plain).select("id", "doc_id", "path", "ord", fetch_text(F.col("text"), n).alias("text"), "line_start", "line_end").first()
        if chunk is None:
            raise KeyError(uri)
        around = navigation.adjacent(t["chunks"], chunk["doc_id"], chunk["ord"], max(0, min(context, 4))).select("id", "ord", "text").collect()
        return chunk.asDict() | {"context": [r.asDict() for r in around]}

    def status(self) -> dict:
        return self.store.state() | {"version": self.store.version()} | (reconcile.statistics(self.store.tables()).first().asDict() if self.store.version() else {})

    def doctor(self) -> dict:
        """Status, and counts that are 0 in a sound index."""
        t = self.store.tables()
        checks = {} if not t else {
            "chunks_without_document": reconcile.orphans(t["chunks"], t["docs"], "doc_id", "doc_id"),
            "symbols_without_document": reconcile.orphans(t["symbols"], t["docs"], "doc_id", "doc_id"),
            "vectors_without_chunk": reconcile.orphans(t["vectors"], t["chunks"], "chunk_id", "id"),
            "chunks_without_vector": reconcile.orphans(t["chunks"], t["vectors"], "id", "chunk_id"),
        }
        return {"ok": not any(checks.values()), "status": self.status(), "checks": checks}


def index_tables(chunks: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """The inverted indexes of chunks and symbols, by which all word searches go, and the sizes that their statistics are summed from."""
    titled = chunks.withColumn("title", F.element_at(F.split("path", "/"), -1))
    words = lexical.postings(titled, "id", list(navigation.CHUNK_WEIGHTS), ["doc_id"])
    names = lexical.postings(symbols, "id", [c for c in navigation.SYMBOL_WEIGHTS if c in symbols.columns], ["doc_id"])
    return {"chunk_postings": words, "symbol_postings": names, "chunk_sizes": lexical.sizes(words, chunks, "doc_id"), "symbol_sizes": lexical.sizes(names, symbols, "doc_id")}


def hash_embedder(dim: int):
    """A deterministic embedding that needs no model: signed counts of hashed character trigrams, with the slots and signs of dense.hash_embedding()."""

    def embed(texts: list[str]):
        import numpy as np

        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            slots, sums = dense.trigram_sums(text.lower(), dim)
            row[slots] = sums
        return out

    return embed
