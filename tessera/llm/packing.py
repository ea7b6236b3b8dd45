"""Best-fit packing of documents into bins of tokens, under conflicts of sources and duplicate clusters."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, word_counts
from .minhash import near_duplicates
from .mixing import numbered

CAPACITY = 4096
#: Pieces of one source in a bin at most.
PER_SOURCE = 8
#: Rows that one task packs, on average.
GROUP_ROWS = 16_384
_OUT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64())])
#: Bins of a block of the residual order.
BLOCK_BINS = 128


class Bins:
    """Open bins in the order of their residuals, in blocks that know what all their bins refuse.

    A bin carries a bitmap for each count up to per_source (bit s of bitmap c: it has more than c pieces of source s)
    and one of the duplicate clusters in it. A block has the AND of its bins' full-source bitmaps and clusters: where it
    has the bit of a piece, every bin in it refuses the piece, and the search goes on behind the block.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.blocks: list[list[tuple[int, int]]] = []
        self.refused: list[tuple[int, int]] = []
        self.planes: list[list[int]] = []
        self.clusters: list[int] = []

    def _refuses(self, bin_: int) -> tuple[int, int]:
        return self.planes[bin_][-1], self.clusters[bin_]

    def _mark(self, k: int) -> None:
        sources, clusters = self._refuses(self.blocks[k][0][1])
        for _, b in self.blocks[k][1:]:
            if not sources and not clusters:
                break
            s, c = self._refuses(b)
            sources, clusters = sources & s, clusters & c
        self.refused[k] = sources, clusters

    def _insert(self, residual: int, bin_: int) -> None:
        if not self.blocks:
            self.blocks, self.refused = [[(residual, bin_)]], [self._refuses(bin_)]
            return
        k = min(bisect_left(self.blocks, (residual, bin_), key=lambda x: x[-1]), len(self.blocks) - 1)
        insort(self.blocks[k], (residual, bin_))
        s, c = self._refuses(bin_)
        self.refused[k] = self.refused[k][0] & s, self.refused[k][1] & c
        if len(self.blocks[k]) > 2 * BLOCK_BINS:
            whole = self.blocks[k]
            self.blocks[k : k + 1] = [whole[:BLOCK_BINS], whole[BLOCK_BINS:]]
            self.refused[k : k + 1] = [(0, 0), (0, 0)]
            self._mark(k)
            self._mark(k + 1)

    def find(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """(block, place in it) of the tightest bin with room for size that has no conflict."""
        k = bisect_left(self.blocks, (size, -1), key=lambda x: x[-1])
        first = True
        while k < len(self.blocks):
            sources, clusters = self.refused[k]
            if not (sources & source or clusters & cluster):
                block = self.blocks[k]
                for j in range(bisect_left(block, (size, -1)) if first else 0, len(block)):
                    bin_ = block[j][1]
                    if not (self.planes[bin_][-1] & source or self.clusters[bin_] & cluster):
                        return k, j
                self._mark(k)
            first = False
            k += 1
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it). source and cluster: a bit each, or 0 for what conflicts with nothing."""
        at = self.find(size, source, cluster)
        if at is None:
            residual, bin_ = self.capacity, len(self.planes)
            self.planes.append([0] * self.per_source)
            self.clusters.append(0)
        else:
            k, j = at
            residual, bin_ = self.blocks[k].pop(j)
            if not self.blocks[k]:
                del self.blocks[k], self.refused[k]
            # what all bins of a block refused still holds for those left
        planes = self.planes[bin_]
        for c in range(self.per_source):
            if not planes[c] & source:
                planes[c] |= source
                break
        self.clusters[bin_] |= cluster
        if residual > size:
            self._insert(residual - size, bin_)
        return bin_, self.capacity - residual


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, largest first. Pieces of one cluster are never in one bin, nor more than per_source of a source."""
    repeated = {c: 1 << i for i, c in enumerate(c for c, n in Counter(clusters).items() if n > 1 and c is not None)}
    bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    bins, out = Bins(capacity, per_source), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.put(sizes[i], bit[sources[i]], repeated.get(clusters[i], 0))
    return out


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _counted_words(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, cluster, text) as (doc_id, source, whole, cluster), whole being the words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, clusters, texts = batch.columns
            yield pa.RecordBatch.from_arrays([ids, sources, pa.array(word_counts(texts), pa.int64()), clusters], names=["doc_id", "source", "whole", "cluster"])

    return rows.mapInArrow(run, "doc_id long, source string, whole long, cluster long")


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(cluster, component): the hash of each text that has near copies, and the least hash that links reach (its own row is left out).

    Texts are compared, not doc_ids: rows without doc_id, and each of several rows of one doc_id, count with their own text.
    """
    found = near_duplicates(docs.select(_text_hash().alias("doc_id"), "text"), shingle, percent).where("not kept")
    return Workspace(docs.sparkSession, "packing").put(found.select(F.col("doc_id").alias("cluster"), F.col("component_id").alias("component")), "near", docs.count())


def packed(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS, size: Column | None = None, cluster: Column | None = None, near: DataFrame | None = None
) -> DataFrame:
    """(doc_id, source, piece, start, size, bin_id, bin_offset): every word of docs (doc_id, text, source) in one bin.

    size: of a document, by default its words; cluster: documents of equal cluster are never in one bin, by default
    equal texts; near: what near_copies() gives, for which equal texts become texts that links reach. A document longer than a bin is cut: its whole pieces fill bins of their own, the rest is packed like a
    document, so nothing is dropped. Rows are dealt to groups of about group_rows by a hash that takes in doc_id, so a hot source or
    cluster spreads evenly; each group is packed by best fit, and bin_id is unique over all groups. Documents without words
    take no part. Repeated rows are packed each (as one cluster, and over all groups); null sources are one source, null ids and other columns don't matter.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")
    same = (_text_hash() if cluster is None else F.xxhash64(cluster)).alias("cluster")
    rows = _counted_words(docs.select(*ids, same, F.col("text").cast("string").alias("text"))) if size is None else docs.select(*ids, size.cast("long").alias("whole"), same)
    rows = rows.where("whole > 0")
    groups = max(1, -(-docs.count() // group_rows))
    ws = Workspace(docs.sparkSession, "pack")
    counted = ws.put(rows.groupBy("doc_id", "source", "whole", "cluster").agg(F.count("*").alias("n")), "rows")
    rows = numbered(counted, counted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "source", "whole", "cluster", "k"), F.lit(groups))).drop("k")
    if near is not None:
        rows = rows.join(broadcast_if_small(near, near.count()), "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster")).drop("component")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("whole", "doc_id", "source", "cluster")])
        ids, sources, whole, clusters, part = (group[c].to_pylist() for c in ("doc_id", "source", "whole", "cluster", "part"))
        at = [i for i, n in enumerate(whole) if n % capacity]
        placed = pack([whole[i] % capacity for i in at], [sources[i] for i in at], [clusters[i] for i in at], capacity, per_source)
        n_bins = max((b for b, _ in placed), default=-1) + 1
        out: list[tuple] = []
        for i, n in enumerate(whole):
            for piece in range(n // capacity):
                out.append((ids[i], sources[i], piece, piece * capacity, capacity, n_bins, 0))
                n_bins += 1
        for i, (bin_, offset) in zip(at, placed, strict=True):
            full = whole[i] // capacity
            out.append((ids[i], sources[i], full, full * capacity, whole[i] % capacity, bin_, offset))
        names = [f.name for f in _OUT]
        columns = [list(c) for c in zip(*out, strict=True)] or [[] for _ in names]
        columns[5] = [(part[0] << 32) + b for b in columns[5]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    return rows.groupBy("part").applyInArrow(run, "doc_id long, source string, piece int, start long, size long, bin_id long, bin_offset long")
