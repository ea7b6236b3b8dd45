"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP

#: Hashes kept: a likeness is off by at most about sqrt(1 / (4 K)).
K = 128
SHINGLE = 5
#: Rows of a range of doc_ids whose texts are dealt to one window, on average.
RANGE_ROWS = 1024
#: Ranges whose order one window looks at.
RANGE_BLOCK = 4096


def sketched(df: DataFrame, text_col: str, to: str, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """df with the sketch of text_col in `to`: the k least hashes of its distinct word shingles, ascending.

    A text of fewer words is one shingle; one without words (or null) has an empty sketch.
    """
    words = F.split(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\x0c\r")), GAP)
    df = df.withColumn("__words", words)
    df = df.withColumn("__words", F.transform("__words", lambda w: F.when(w != "", F.xxhash64(w))))
    n = F.size("__words")
    at = F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))
    many = F.transform(at, lambda i: F.xxhash64(*(F.get("__words", i + j) for j in range(shingle))))
    few = F.array(F.xxhash64(n, F.col("__words")))
    none = F.slice(few, 1, 0)
    hashes = F.when(n >= shingle, many).when(F.get("__words", F.lit(0)).isNotNull(), few).otherwise(none)
    return df.withColumn(to, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("__words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together. Exact: the same as if they had been sketched as one set."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimates |A and B| / |A or B|: the share of the union's sketch that is in both. 1 for two empty sets."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimates the number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimates |A and B| / |A|. 1 for an empty A."""
    both = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def encoded(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, 8 bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def decoded(text: Column) -> Column:
    """The sketch of an encoded text."""
    digits = F.hex(F.unbase64(text))
    at = F.sequence(F.lit(0), F.greatest(F.length(digits) / 16 - 1, F.lit(0)).cast("int"))
    high = lambda i, k: F.conv(F.substr(digits, i * 16 + 1 + k * 8, F.lit(8)), 16, 10).cast("long")
    return F.when(F.length(digits) == 0, F.slice(F.array(F.lit(0).cast("long")), 1, 0)).otherwise(F.transform(at, lambda i: F.shiftleft(high(i, 0), 32).bitwiseOR(high(i, 1))))


def with_next(docs: DataFrame, id_col: str, text_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(part, ghost, doc_id, text): docs cut into ranges of doc_id, each with the row that follows it as a ghost.

    Sorted by ghost and doc_id, each row but the ghost has its successor behind it within the range, so no window
    spans the table. The last range gets the first row. The ranges are equally wide and made for range_rows rows
    if the ids are spread evenly (distinct integers never put more rows in one than its width).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    count, low, high = docs.agg(F.count("*"), F.min("doc_id").cast("double"), F.max("doc_id").cast("double")).first()
    width = max(1.0, ((high or 0) - (low or 0) + 1) * range_rows / max(count, 1))
    part = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(low or 0.0)) / F.lit(width)), F.lit(-1))
    rows = docs.withColumn("part", part)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("tie"))
    heads = rows.groupBy("part").agg(F.min(order).alias("head"))
    # one row for each range; ranges are looked at in blocks of RANGE_BLOCK, and only the blocks' ends in one window
    heads = heads.withColumn("block", F.floor(F.col("part") / RANGE_BLOCK))
    ends, every = Window.orderBy("block"), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = heads.groupBy("block").agg(F.max("part").alias("last")).select("block", F.coalesce(F.lag("last").over(ends), F.max("last").over(every)).alias("before"))
    inner = F.lag("part").over(Window.partitionBy("block").orderBy("part"))
    heads = heads.withColumn("inner", inner).join(blocks, "block").select(F.coalesce("inner", "before").alias("into"), F.col("part").alias("from"), "head")
    ghosts = rows.join(heads, (F.col("part") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.xxhash64("text") == F.col("head.tie")))
    ghosts = ghosts.select(F.col("into").alias("part"), F.lit(1).alias("ghost"), "doc_id", "text")
    return rows.select("part", F.lit(0).alias("ghost"), "doc_id", "text").unionByName(ghosts)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is taken from the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Next: by ascending doc_id,
    after the last the first (a single document follows itself). Null texts are empty; null doc_ids come first; rows of one
    doc_id are ordered by a hash of the text. Other columns don't matter.
    """
    window = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    both = with_next(docs, id_col, text_col, range_rows).withColumn("next", F.coalesce(F.lead("text").over(window), F.lit("")))
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int")).withColumn("tie", F.xxhash64("text"))
    both = both.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("half")), F.substr("next", F.lit(1), F.col("half"))))
    both = sketched(sketched(both, "text", "own"), "edited", "changed")
    both = both.select("part", "ghost", "doc_id", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "changed")
    again = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "tie")
    both = both.withColumn("following", F.lead("own").over(again)).where("ghost = 0")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.col("own")).alias("fingerprint"), encoded(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"), resemblance(F.col("own"), F.col("following")).alias("near_next"),
    )
