"""What the operators share: tables in the shared folder, and words in vectorised form."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Text that is turned into arrays at once, in bytes (one longer text is taken alone).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where none is set, one beside the warehouse's tables (in local mode a temporary one)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        local = spark.sparkContext.master.startswith("local")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Rows of a few numbers that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows of a few numbers, marked for broadcast if they are no more than BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def in_few_parts(df: DataFrame, rows: int, per_part: int = 100_000) -> DataFrame:
    """df, which has about so many rows and little work to a row, in as few partitions as that takes: small results don't become many tiny files."""
    return df.coalesce(max(1, -(-rows // per_part)))


def gathered(df: DataFrame, rows: int, per_part: int = 100_000) -> DataFrame:
    """df, which has no more than so many small rows, in few partitions, dealt anew behind its work, which stays in as many tasks as it takes."""
    return df.repartition(max(1, -(-rows // per_part)))


class Workspace:
    """Tables in the shared folder. Writing one cuts the lineage, and it outlives any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
        """df as a table. rows: how many it has at most, if that is known; it is then written in as few files as that takes."""
        if rows is not None:
            df = in_few_parts(df, rows, per_file)
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no plan reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
        """df as the last table of this workspace; all others are deleted."""
        out = self.put(df, "result", rows, per_file)
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.drop(*(x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName() != "result"))
        return out


def slices(texts: pa.Array):
    """(start, end) of runs of texts of about SLICE_BYTES."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
    at = [0, *cuts.tolist(), len(texts)]
    yield from zip(at[:-1], at[1:], strict=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mix_in_place(x: np.ndarray) -> None:
    """x = mixed(x), in runs, so that a long array takes no second one."""
    for a in range(0, len(x), RUN):
        x[a : a + RUN] = mixed(x[a : a + RUN])


#: Numbers that are worked on at once.
RUN = 1 << 20
#: Bytes of text whose words are told apart at once; a longer text is cut behind white space.
PIECE_BYTES = 4 << 20
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAPS = SPACES.tobytes()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts end to end, and where each begins (and the last ends). A null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def behind(data: np.ndarray, table: np.ndarray, at: int, end: int) -> int:
    """The place behind the first byte from `at` on that the table marks, or the end."""
    while at < end:
        hit = np.flatnonzero(table[data[at : min(at + 65_536, end)]])
        if len(hit):
            return at + int(hit[0]) + 1
        at += 65_536
    return end


def pieces(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
    """Runs of texts, or of pieces of long ones (cut behind bytes that the table marks), of about PIECE_BYTES: (bounds, numbers of their texts)."""
    bounds, owners = [0], []
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        while True:
            cut = b if b - a <= PIECE_BYTES else behind(data, table, a + PIECE_BYTES, b)
            if owners and cut - bounds[0] > PIECE_BYTES:
                yield bounds, owners
                bounds, owners = [a], []
            bounds.append(cut)
            owners.append(i)
            a = cut
            if a == b:
                break
    if owners:
        yield bounds, owners


def as_texts(data: bytes, bounds: np.ndarray) -> pa.Array:
    """The parts of some bytes as an array of texts, without a copy."""
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def hashed(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text, the same in every process; each distinct one is hashed once."""
    coded = texts.dictionary_encode()
    data, ends = flat(coded.dictionary)
    data, ends = data.tobytes(), ends.tolist()  # cut here: to_pylist() makes an Arrow scalar of each, which takes longer than all else
    own = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))[coded.indices.to_numpy(zero_copy_only=False)]


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many words each text has; a null text has none. Beside the texts this takes memory for one run of bytes at a time."""
    data, ends = flat(texts)
    first = ends[:-1][np.diff(ends) > 0]
    before = np.zeros(len(ends), np.int64)  # words that begin before each end
    for a in range(0, len(data), RUN):
        gap = np.frombuffer(data[max(a - 1, 0) : a + RUN].tobytes().translate(_GAPS), bool)
        starts = ~gap[min(a, 1) :]
        starts[1 - min(a, 1) :] &= gap[:-1]
        own = first[np.searchsorted(first, a) : np.searchsorted(first, a + RUN)]
        starts[own - a] = ~SPACES[data[own]]
        before += np.searchsorted(np.flatnonzero(starts) + a, ends)
    return np.diff(before)


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, the same in every process, and the offsets of each text's words.

    `lower` takes A-Z as a-z. A null text has no words. Beside 8 bytes for each word this takes memory for one piece of text at a time (or one
    word, if that is longer).
    """
    data, ends = flat(texts)
    parts, counts = [], np.zeros(len(texts), np.int64)
    for bounds, owners in pieces(data, ends, SPACES):
        raw = data[bounds[0] : bounds[-1]].tobytes()
        split = pc.ascii_split_whitespace(as_texts(raw.translate(_LOWER) if lower else raw, np.array(bounds) - bounds[0]))
        words, of = split.flatten(), np.asarray(split.offsets)
        real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        parts.append(hashed(words)[real])
        np.add.at(counts, owners, np.diff(np.concatenate(([0], np.cumsum(real)))[of - of[0]]))
    return (parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])), np.concatenate(([0], np.cumsum(counts)))


def rolling(h: np.ndarray, size: int, start: np.uint64) -> np.ndarray:
    """A hash of each window of `size` of the numbers in h."""
    out = np.full(max(0, len(h) - size + 1), start, np.uint64)
    for a in range(0, len(out), RUN):
        own = out[a : a + RUN]
        for i in range(size):
            own *= _STEP
            own += h[a + i : a + i + len(own)]
        own[:] = mixed(own)
    return out


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of x in order; x is sorted in place."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


def shingle_sets(texts: pa.Array, size: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, end to end, and the offsets.

    A text of fewer words than `size` has its whole sequence as its one shingle; one without words has none. A text of n words takes
    up to 24 n bytes at a time beside its own.
    """
    h, offsets = word_hashes(texts, lower)
    short = {}
    for i in np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < size)).tolist():
        own = h[offsets[i] : offsets[i + 1]]
        short[i] = rolling(own, len(own), np.uint64(len(own)))
    rolled = rolling(h, size, np.uint64(size))
    del h
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            own = distinct_sorted(rolled[a : b - size + 1]) if b - a >= size else short[i]
            parts.append(own)
            counts[i] = len(own)
    del rolled
    return (parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])), np.concatenate(([0], np.cumsum(counts)))
