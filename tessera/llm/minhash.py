"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct word shingles. Its signature has CHUNKS chunks of WIDTH values of 16 bits, one
chunk to a long. If two signatures differ in at most 2 * CHUNKS - 1 values, some chunk differs in at most one
(pigeonhole), so every chunk is entered WIDTH times in the index, each time with one value left out, and each
such pair meets under a key: MAX_DISTANCE is that number, so every pair under the threshold meets. Documents of a resemblance of 0.8
have signatures beyond it with probability 1.3e-6, and of more with less. What meets is confirmed on the full sets.

Copies never become pairs of rows. Equal sets are one class. Under each key the classes are first held against the
least one (a star, so at most one pair for each entry), the confirmed pairs give components, and only keys
that still hold several components are looked at again: rows of small keys that are in different components are
paired, if the signatures allow it; in large keys, rows outside the largest component are held against all
rows in blocks of bounded size, and one link to each component is enough. No cap drops anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RUN, Workspace, broadcast_if_small, gathered, in_few_parts, mixed, shingle_sets, slices
from .components import connected_components

CHUNKS, WIDTH = 13, 4
#: Signatures of candidates differ in no more of their values: what the index guarantees to find.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Keys of more rows are compared in blocks.
SMALL_KEY = 64
#: Shingles in each side of a block: 8 MB.
BLOCK_SHINGLES = 1_000_000

_SIGS = [f"s{i}" for i in range(CHUNKS)]
_rng = np.random.default_rng(11)
_MUL = _rng.integers(1, 1 << 63, CHUNKS * WIDTH, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, CHUNKS * WIDTH, dtype=np.uint64)


def signature(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of CHUNKS longs for the sets that lie end to end in `hashes`; zeros for empty ones."""
    least = np.full((CHUNKS * WIDTH, len(offsets) - 1), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), RUN):
        run = hashes[a : a + RUN]
        row = np.arange(np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, a + len(run), "left"))
        row = row[offsets[row] < offsets[row + 1]]  # the sets with hashes in this run
        starts = np.maximum(offsets[row] - a, 0)
        for i, (m, c) in enumerate(zip(_MUL, _ADD, strict=True)):
            least[i, row] = np.minimum(least[i, row], np.minimum.reduceat(run * m + c, starts))
    out = np.zeros((len(offsets) - 1, CHUNKS), np.uint64)
    full = np.diff(offsets) > 0
    for i in range(CHUNKS * WIDTH):
        out[full, i // WIDTH] |= (mixed(least[i, full]) >> np.uint64(48)) << np.uint64(16 * (i % WIDTH))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, k1, k2, s0...): size of the set, 128 bits that stand for it, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                hashes, offsets = shingle_sets(batch.column(1).slice(a, b - a), shingle, lower=True)
                keys = np.frombuffer(b"".join(hashlib.blake2b(hashes[i:j], digest_size=16).digest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)), np.int64).reshape(-1, 2)
                sig = signature(hashes, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *(_signed(np.ascontiguousarray(sig[:, i])) for i in range(CHUNKS))],
                    names=["doc_id", "n", "k1", "k2", *_SIGS],
                )

    schema = ", ".join(f"{c} long" for c in ["doc_id", "n", "k1", "k2", *_SIGS])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def sets_of(docs: DataFrame, ids: DataFrame, ws: Workspace, name: str, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, set binary): the sorted shingle hashes of the documents named in ids (k1 and k2 tell which row of a doc_id)."""
    n_ids = ids.count()
    own = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    own = own.join(broadcast_if_small(ids, n_ids), "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                h, o = shingle_sets(batch.column(1).slice(a, b - a), shingle, lower=True)
                sets = [h[i:j].tobytes() for i, j in zip(o[:-1], o[1:], strict=True)]
                keys = [int.from_bytes(hashlib.blake2b(s, digest_size=16).digest()[:8], "little", signed=True) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "k1", "set"])

    found = own.mapInArrow(run, "rep long, k1 long, set binary")
    # a repeated doc_id counts with the least key, as in classes()
    return ws.put(found.groupBy("rep").agg(F.min(F.struct("k1", "set")).alias("x")).select("rep", "x.set"), name)


def _distance(a: str, b: str) -> Column:
    out = F.lit(0)
    for s in _SIGS:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for i in range(WIDTH):
            out = out + F.when(F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) != 0, 1).otherwise(0)
    return out


def _alike(a: str, b: str, percent: int) -> Column:
    """What the sizes and the signatures of two classes allow."""
    least, most = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * least >= percent * most) & (_distance(a, b) <= MAX_DISTANCE)


def index_keys(reps: DataFrame) -> DataFrame:
    """(rep, n, key): each chunk WIDTH times, with one of its values left out."""
    keys = [
        F.xxhash64(F.lit(c * WIDTH + d), F.col(s).bitwiseAND(F.lit(~(0xFFFF << (16 * d)) if 16 * d < 48 else (1 << 48) - 1)))
        for c, s in enumerate(_SIGS)
        for d in range(WIDTH)
    ]
    return reps.select("rep", "n", F.explode(F.array(*keys)).alias("key"))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), no more than n_pairs, whose full sets resemble each other enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = sets.join(broadcast_if_small(ends, 2 * n_pairs), "rep", "left_semi")  # only what is asked for is shuffled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            keep = pa.array([linked(x, y, percent) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    with_a = with_b.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
    return with_a.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _tiles(large: DataFrame, weight: Column, most: int) -> DataFrame:
    """The rows of each key twice, in the blocks (i, j) of `most` weight a side: all of them, and as asking those outside of its largest component."""
    main = large.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum(weight).alias("w"))
    main = main.groupBy("key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("w").alias("all"), (F.sum("w") - F.max(F.struct("rows", "comp", "w"))["w"]).alias("rest"))
    tall = F.greatest(F.lit(1), F.ceil(F.col("all") / most)).cast("int")
    wide = F.greatest(F.lit(1), F.ceil(F.col("rest") / most)).cast("int")
    rows = large.join(main, "key").select(*large.columns, (F.col("comp") != F.col("main")).alias("asks"), tall.alias("tall"), wide.alias("wide"))
    h = F.xxhash64("rep")
    against = rows.select(*large.columns, F.lit(False).alias("asks"), F.pmod(h, "tall").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
    asking = rows.where("asks").select(*large.columns, "asks", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("i"), F.pmod(h, "wide").alias("j"))
    return against.unionByName(asking)


def _blocks(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between rows of different components under the large keys. large: key, rep, comp, n."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["asks"].to_numpy(zero_copy_only=False)
        reps, comps = group["rep"].to_numpy(), group["comp"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
        pool = np.flatnonzero(~asks)
        sizes = np.array([len(sets[i]) for i in pool], np.int64)
        flat, starts = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in pool)]), np.cumsum(sizes) - sizes
        a, b = [], []
        for i in np.flatnonzero(asks) if len(pool) else ():
            own = sets[i]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
            near = pool[(100 * both >= percent * (sizes + len(own) - both)) & (comps[pool] != comps[i])]
            _, first = np.unique(comps[near], return_index=True)
            a += [reps[i]] * len(first)
            b += reps[near[first]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tiles = _tiles(large, F.col("n"), BLOCK_SHINGLES).select("key", "rep", "comp", "asks", "i", "j")
    return tiles.join(sets, "rep").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents with 100 * |A and B| >= percent * |A or B|.

    A-Z count as a-z. component_id is the smallest doc_id that links reach; kept marks that document. Documents
    without words (or null text) have an empty set and stand alone. Rows of one doc_id are one document (the
    set of least key counts if they differ). Rows without doc_id are not linked: component_id is null, and
    they are kept. Other columns don't matter. percent must be 80 or more for the recall given above. A text of n words takes up to 24 n
    bytes at a time beside its own, so one of 100 MB some 600 MB.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    raw = ws.put(signatures(docs, shingle, id_col, text_col), "raw")
    n_docs = raw.count()
    own = raw.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n", *_SIGS)).alias("x")).select("doc_id", "x.*")
    sigs = ws.put(own, "sigs", n_docs, 20_000)
    reps = ws.put(sigs.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ["n", *_SIGS])), "reps", n_docs, 20_000)
    keys = index_keys(reps)
    shared = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("rows")).where("rows > 1")
    hits = ws.put(keys.join(shared, "key"), "hits")
    n_hits = hits.count()

    def allowed(pairs: DataFrame) -> DataFrame:
        x, y = reps.alias("x"), reps.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep")).where(_alike("x", "y", percent)).select("a", "b")

    stars = hits.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    stars = ws.put(allowed(stars), "stars", n_hits)
    ids = ws.put(stars.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ids", n_docs)
    sets = sets_of(docs, ids, ws, "sets", shingle, id_col, text_col)
    n_stars = stars.count()
    links = ws.put(gathered(confirm(stars, n_stars, sets, percent), n_stars), "links")
    ws.drop("sets", "ids")
    first = ws.put(connected_components(links, ws, rows=n_hits), "first", n_docs)
    of = first.select(F.col("node").alias("rep"), "component")

    entries = hits.join(of, "rep", "left").select("key", "rep", "n", "rows", F.coalesce("component", "rep").alias("comp"))
    entries = ws.put(entries, "entries", n_hits)
    ws.drop("hits")
    mixed_keys = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = ws.put(entries.join(mixed_keys, "key"), "left", n_hits)
    few = left.where(F.col("rows") <= SMALL_KEY).select("key", "rep", "comp")
    x, y = few.select("key", F.col("rep").alias("a"), F.col("comp").alias("ca")), few.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    rest = allowed(x.join(y, "key").where("a < b and ca <> cb").select("a", "b").distinct())
    rest = ws.put(rest.join(stars, ["a", "b"], "left_anti"), "rest", n_hits)
    large = left.where(F.col("rows") > SMALL_KEY).select("key", "rep", "comp", "n")
    ids = ws.put(rest.select(F.explode(F.array("a", "b")).alias("rep")).union(large.select("rep")).distinct(), "ids2", n_docs)
    sets = sets_of(docs, ids, ws, "sets2", shingle, id_col, text_col)
    # heavy to find, small to write: each in as many tasks as its sets and blocks fill, then in few files
    n_rest, n_large = rest.count(), large.count()
    more = ws.put(gathered(confirm(rest, n_rest, sets, percent).unionByName(_blocks(large, sets, percent)), n_rest + n_large), "more")
    ws.drop("sets2", "ids2", "left", "entries")
    ends = more.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = ws.put(connected_components(ends, ws, rows=n_hits), "second", n_docs)

    labels = reps.select("k1", "k2", "rep").join(of, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c1"))
    labels = labels.join(second.toDF("c1", "c2"), "c1", "left").select("k1", "k2", F.coalesce("c2", "c1").alias("component"))
    out = sigs.join(labels, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = raw.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return ws.finish(out.unionByName(nameless), n_docs)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document is kept by near_duplicates(), on shingles of five words; same columns.

    Of several rows of one doc_id the one of the least text stays. Rows without doc_id stay.
    """
    ws = Workspace(docs.sparkSession, "dedup")
    gone = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone"))
    own = docs[id_col].cast("long")
    left = docs.join(broadcast_if_small(gone, gone.count()), own == F.col("__gone"), "left_anti")
    repeated = docs.where(own.isNotNull()).groupBy(own.alias("__again")).count().where("count > 1").select("__again")
    again = ws.put(gathered(repeated, docs.count(), 1_000_000), "again")
    again = broadcast_if_small(again, again.count())
    once = left.join(again, left[id_col].cast("long") == F.col("__again"), "left_anti")
    rows = left.join(again, left[id_col].cast("long") == F.col("__again")).select("__again", F.struct(*(left[c] for c in left.columns)).alias("__row"), left[text_col].cast("string").alias("__text"))
    first = rows.groupBy("__again").agg(F.min_by("__row", F.struct(F.col("__text"), F.xxhash64(F.to_json("__row")))).alias("__row")).select("__row.*")
    return once.unionByName(first)
