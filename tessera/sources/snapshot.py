"""The index as versioned, bucketed Parquet tables: an update writes the buckets that it touches, and one rename makes them current."""

from __future__ import annotations

import contextlib
import json
import os
import socket
import time
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables of an index, and what each is sorted by within its files, so that lookups skip row groups.
TABLES = {
    "docs": ("path",), "chunks": ("doc_id", "ord"), "symbols": ("name",), "refs": ("target_name_lc",), "vectors": ("chunk_id",),
    "chunk_postings": ("term",), "symbol_postings": ("term",), "chunk_sizes": ("doc_id",), "symbol_sizes": ("doc_id",),
}
SCHEMA_VERSION = 2
#: Buckets of a table by the hash of its key. An update rewrites whole buckets: choose as many as make a bucket what one update may write.
BUCKETS = 32


class NotQueryable(RuntimeError):
    """The index is not ready: nothing is published yet, or the last run failed."""


class Locked(RuntimeError):
    """Another writer holds the index."""


class SnapshotStore:
    """Snapshots under a folder that driver and executors share (any file system of Spark's).

    data/<table>/v=<version>/bucket=<n> holds a bucket as one run wrote it; manifests/<version>.json says which buckets make up a snapshot, CURRENT.json is the
    manifest to read, and STATE.json tells how the last run went. A run that fails leaves the current snapshot as it was.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # --- small files -----------------------------------------------------------------------------------------

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, name: str, value: dict, overwrite: bool) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), overwrite)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def _write(self, name: str, value: dict) -> None:
        """Whole or not at all: written under another name, then renamed over the old one in one step."""
        self._create(f"{name}.new", value, True)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        root = self._path(self.root)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), self._conf)
        files.rename(self._path(f"{self.root}/{name}.new"), self._path(f"{self.root}/{name}"), how)

    # --- reading ----------------------------------------------------------------------------------------------

    def state(self) -> dict:
        return self._read("STATE.json") or {"state": "empty"}

    def current(self) -> dict | None:
        """The manifest to read."""
        return self._read("CURRENT.json")

    def version(self) -> int | None:
        current = self.current()
        return current and current["version"]

    def check(self) -> int:
        """The version to query; an error while an index is being built for the first time or after a failed run."""
        state, version = self.state()["state"], self.version()
        if version is None or state == "failed" or state == "building" and self.state().get("exclusive"):
            raise NotQueryable(f"the index is {state}")
        return version

    def _manifest(self, version: int | None) -> dict:
        return self._read(f"manifests/{version or self.check()}.json")

    def _table(self, manifest: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        held = manifest["tables"][name]
        schema = StructType.fromJson(json.loads(held["schema"]))
        paths = [f"{self.root}/data/{name}/v={v}/bucket={b}" for b, v in held["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self._table(self._manifest(version), name, buckets)

    def tables(self, version: int | None = None, buckets: list[int] | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot, of all buckets or some."""
        manifest = self._manifest(version) if version else self.current()
        return {name: self._table(manifest, name, buckets) for name in manifest["tables"]} if manifest else {}

    # --- writing ----------------------------------------------------------------------------------------------

    def _lock(self) -> None:
        """A file that only one writer can create. One of a process of this host that is gone is taken over."""
        mine = {"host": socket.gethostname(), "pid": os.getpid(), "since_ns": time.time_ns()}
        for _ in range(2):
            try:
                self._create("WRITER.lock", mine, False)
                return
            except Py4JJavaError as e:
                held = self._read("WRITER.lock") or {}
                if held.get("host") != mine["host"] or os.path.exists(f"/proc/{held.get('pid')}"):
                    raise Locked(f"another writer holds the index: {held}") from e
                self._fs.delete(self._path(f"{self.root}/WRITER.lock"), False)
        raise Locked("another writer took the index")

    @contextlib.contextmanager
    def writing(self, fingerprint: str = "") -> Iterator[None]:
        """Holds the writer lock (a second writer fails at once) and keeps the state: building, then ready, or failed with the error."""
        self._lock()
        try:
            started = time.time_ns()
            self._write("STATE.json", {"state": "building", "started_ns": started, "fingerprint": fingerprint})
            try:
                yield
            except BaseException as e:
                self._write("STATE.json", {"state": "failed", "started_ns": started, "finished_ns": time.time_ns(), "error": f"{type(e).__name__}: {e}"[:500]})
                raise
            self._write("STATE.json", {"state": "ready", "started_ns": started, "finished_ns": time.time_ns(), "fingerprint": fingerprint})
        finally:
            self._fs.delete(self._path(f"{self.root}/WRITER.lock"), False)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, key: str = "doc_id") -> list[int]:
        """The buckets of the keys: no more numbers than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket_of(F.col(key))).distinct().collect())

    def publish(self, tables: dict[str, DataFrame], fingerprint: str = "", buckets: list[int] | None = None, keys: dict[str, str] | None = None) -> int:
        """Writes the tables (all of each, or the named buckets) and makes a snapshot current in which what is not written is as it was.

        A table is dealt to buckets by doc_id, or by its key in keys. Vectors, one for each chunk, must be as many as the chunks they belong to.
        """
        old, version = self.current(), max(time.time_ns(), (self.version() or 0) + 1)
        if old and old["schema_version"] != SCHEMA_VERSION and not set(TABLES) <= set(tables):
            raise RuntimeError("the index was written by another version; rebuild it")
        whole = buckets is None and set(TABLES) <= set(tables)
        if old and fingerprint and old["fingerprint"] and old["fingerprint"] != fingerprint and not whole:
            raise RuntimeError("the settings have changed; rebuild the index")
        if old and old["buckets"] != self.buckets and not whole:
            raise RuntimeError(f"the index has {old['buckets']} buckets; rebuild it for another number")
        kept = dict(old["tables"]) if old and not whole else {}
        for name, df in tables.items():
            key = (keys or {}).get(name, "doc_id")
            place, order = f"{self.root}/data/{name}/v={version}", [c for c in TABLES.get(name, ()) if c in df.columns]
            dealt = df.withColumn("bucket", self.bucket_of(F.col(key))).hint("rebalance", F.col("bucket"))
            dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(place)
            made = {s.getPath().getName().removeprefix("bucket="): version for s in self._fs.listStatus(self._path(place)) if s.getPath().getName().startswith("bucket=")}
            if buckets is not None:
                made = {b: v for b, v in kept.get(name, {"buckets": {}})["buckets"].items() if int(b) not in buckets} | made
            kept[name] = {"schema": df.schema.json(), "key": key, "buckets": made}
        manifest = {"version": version, "schema_version": SCHEMA_VERSION, "fingerprint": fingerprint or (old or {}).get("fingerprint", ""), "buckets": self.buckets, "tables": kept}
        if {"chunks", "vectors"} <= set(tables):
            counts = [self._table(manifest, name, buckets).count() for name in ("chunks", "vectors")]  # from the files' footers
            if counts[0] != counts[1]:
                raise RuntimeError(f"{counts[0]} chunks, {counts[1]} vectors")
        self._create(f"manifests/{version}.json", manifest, False)
        self._write("CURRENT.json", manifest)
        return version

    def merge(self, name: str, rows: DataFrame, key: str) -> int:
        """Rows in place of those of the same key: only the buckets of their keys are read and written."""
        from tessera.operators.reconcile import upsert

        current = self.current()
        if not current or name not in current["tables"]:
            return self.publish({name: rows}, keys={name: key})
        touched = self.buckets_of(rows, key)
        return self.publish({name: upsert(self._table(current, name, touched), rows, key)}, buckets=touched, keys={name: key}) if touched else current["version"]

    def optimise(self) -> int:
        """Writes all tables anew, each bucket sorted for lookups in as few files as its size takes."""
        held = self.current()
        return self.publish({name: self._table(held, name) for name in held["tables"]}, held["fingerprint"], keys={name: t["key"] for name, t in held["tables"].items()})

    def drop_old(self, keep: int = 2) -> list[int]:
        """Deletes all but the newest snapshots (the current one always stays), and the buckets that no other snapshot has."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        versions = sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)
        gone = [v for v in versions[keep:] if v != self.version()]
        if not gone:
            return []
        live = {(name, b, v) for version in set(versions) - set(gone) for name, t in self._manifest(version)["tables"].items() for b, v in t["buckets"].items()}
        for version in gone:
            for name, t in self._manifest(version)["tables"].items():
                for b, v in t["buckets"].items():
                    if (name, b, v) not in live:
                        self._fs.delete(self._path(f"{self.root}/data/{name}/v={v}/bucket={b}"), True)
            self._fs.delete(self._path(f"{self.root}/manifests/{version}.json"), False)
        return gone
