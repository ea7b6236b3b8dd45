"""Blocks of PDF pages, from tables of blocks: margins, kinds, boxes, tables, sections and chunks.

A block has doc_id, page, ord (its place in the page), text, bbox (array of four doubles), font_size, bold_ratio, mono_ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import header_key

HEADING_SIZE, BOLD_SIZE, BOLD_SHARE, MONO_SHARE, HEADING_CHARS = 1.18, 0.98, 0.65, 0.55, 180


def without_margins(blocks: DataFrame, share: float = 0.55, where: Column | None = None) -> DataFrame:
    """blocks without those whose normalised text stands on at least max(2, int(share * pages + 0.999)) pages of their document.

    where: the blocks that count as margins (by default all)."""
    key = F.md5(header_key(F.col("text")))
    test = F.lit(True) if where is None else where
    # one shuffle of (document, key, page), keys as hashes: pages of each key, and from their null key the pages of the document
    keys = F.array_distinct(F.array(F.lit(None).cast("string"), F.when(test & (header_key(F.col("text")) != ""), key)))
    df = blocks.select("doc_id", "page", F.explode(keys).alias("__key")).distinct().groupBy("doc_id", "__key").agg(F.count("*").alias("__df"))
    df = df.withColumn("__pages", F.max(F.when(F.col("__key").isNull(), F.col("__df"))).over(Window.partitionBy("doc_id")))
    gone = df.where(F.col("__key").isNotNull() & (F.col("__df") >= F.greatest(F.lit(2), F.floor(F.lit(share) * F.col("__pages") + 0.999)))).select("doc_id", "__key")
    keyed = blocks.withColumn("__key", F.when(test, key))
    return keyed.join(gone, ["doc_id", "__key"], "left_anti").select(*blocks.columns)


def body_size(blocks: DataFrame) -> DataFrame:
    """(doc_id, body): the median font size, each block weighted by its length."""
    weight = F.greatest(F.lit(1), F.least(F.lit(50), F.floor(F.length("text") / 20).cast("int")))
    return blocks.groupBy("doc_id").agg(F.percentile("font_size", F.lit(0.5), weight).alias("body"))


def classified(blocks: DataFrame) -> DataFrame:
    """blocks with kind: heading, code or text."""
    both = blocks.join(body_size(blocks).withColumnRenamed("body", "__body"), "doc_id")
    short = (F.length("text") <= HEADING_CHARS) & ~F.col("text").contains("\n\n")
    big = F.col("font_size") >= HEADING_SIZE * F.col("__body")
    bold = (F.col("bold_ratio") >= BOLD_SHARE) & (F.col("font_size") >= BOLD_SIZE * F.col("__body"))
    kind = F.when(short & (big | bold), "heading").when(F.col("mono_ratio") >= MONO_SHARE, "code").otherwise("text")
    return both.withColumn("kind", kind).drop("__body")


def bbox_union(blocks: DataFrame, *keys: str) -> DataFrame:
    """The box around the boxes of each group, rounded to two places."""
    b = lambda i: F.get("bbox", F.lit(i))
    return blocks.groupBy(*keys).agg(F.array(*(F.round(F.min(b(i)) if i < 2 else F.max(b(i)), 2) for i in range(4))).alias("bbox"))


def table_markdown(rows: Column) -> Column:
    """An array of rows (arrays of strings) as a markdown table: rows padded to the widest, the first one the head."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    clean = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.array_repeat(F.lit("---"), width)
    lines = F.concat(F.array(line(F.get(padded, F.lit(0))), line(rule)), F.transform(F.slice(padded, 2, F.size(rows)), line))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise("")


def page_titles(outline: DataFrame) -> DataFrame:
    """(doc_id, page, title): the last outline title of each page; pos orders the outline."""
    return outline.groupBy("doc_id", "page").agg(F.max_by("title", "pos").alias("title"))


def pdf_chunks(blocks: DataFrame, titles: DataFrame | None = None, tokens: int = 512, overlap: int = 48, repeat_tail: bool = False) -> DataFrame:
    """(doc_id, page, ord, section, chunk_type, text, bbox, block_kinds): classified blocks packed to a token budget.

    Pages are packed each for itself, in one pass over their blocks; a heading starts a section (and is not chunk text), a table
    ends the chunk before it. The next chunk carries over the last blocks of up to `overlap` tokens, at least one; repeat_tail
    also emits a carry that nothing follows.
    """
    rows = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "text", "bbox"))).alias("blocks"))
    if titles is not None:
        rows = rows.join(titles.select("doc_id", "page", "title"), ["doc_id", "page"], "left")
    else:
        rows = rows.withColumn("title", F.lit(None).cast("string"))

    def pack(page_blocks: list[dict], title: str | None) -> list[dict]:
        out, section = [], title or ""
        held: list[dict] = []
        fresh = 0  # blocks that no chunk has yet

        def flush(carry: bool) -> None:
            nonlocal held, fresh
            if held and (fresh or repeat_tail):
                kinds = [b["kind"] for b in held]
                kind = "pdf_table" if "table" in kinds else "pdf_code" if kinds.count("code") * 2 > len(kinds) else "pdf_text"
                boxes = [b["bbox"] for b in held if b["bbox"]]
                box = [round(f(x[i] for x in boxes), 2) for i, f in enumerate((min, min, max, max))] if boxes else None
                out.append({"section": section[:160], "chunk_type": kind, "text": "\n\n".join(b["text"] for b in held), "bbox": box, "block_kinds": sorted(set(kinds))})
            kept: list[dict] = []
            if carry and overlap and held:
                size = 0
                for b in reversed(held):
                    if kept and size + len(b["text"]) // 4 > overlap:
                        break
                    kept.insert(0, b)
                    size += len(b["text"]) // 4
            held, fresh = kept, 0

        for b in page_blocks:
            if b["kind"] == "heading":
                if sum(len(x["text"]) // 4 for x in held) >= tokens // 2:
                    flush(False)
                section = b["text"].strip()
                continue
            size = max(1, len(b["text"]) // 4)
            if held and (b["kind"] == "table" or sum(len(x["text"]) // 4 for x in held) + size > tokens):
                flush(b["kind"] != "table")
            held.append(b)
            fresh += 1
        flush(False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for i, c in enumerate(pack(row["blocks"], row["title"])):
                    out.append({"doc_id": row["doc_id"], "page": row["page"], "ord": i} | c)
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = dict(rows.dtypes)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema(
        [("doc_id", arrow[kinds["doc_id"]]), ("page", arrow[kinds["page"]]), ("ord", pa.int32()), ("section", pa.string()), ("chunk_type", pa.string()), ("text", pa.string()), ("bbox", pa.list_(pa.float64())), ("block_kinds", pa.list_(pa.string()))]
    )
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, ord int, section string, chunk_type string, text string, bbox array<double>, block_kinds array<string>")
