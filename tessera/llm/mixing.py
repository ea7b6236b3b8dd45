"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, broadcast_if_small

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Times that a source's words can be taken at most.
MOST = 3
#: Documents of a block of the reduction tree, on average.
BLOCK = 128
SEED = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, n): how many rows of docs (doc_id, text, source) have them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, most: int, step: int = 1 << 16) -> DataFrame:
    """Each row n times, numbered from 0 in k. Where one row stands for more than `step` (most: the greatest n), its numbers are dealt to all tasks first."""
    if most > step:
        at = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))
        rows = rows.withColumn("__from", F.explode(at)).repartition(rows.sparkSession.sparkContext.defaultParallelism)
        last = F.least(F.col("__from") + step, F.col("n")) - 1
        return rows.withColumn("k", F.explode(F.sequence("__from", last))).drop("n", "__from")
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, rows, target) of sized_rows(): the shares of all sizes by weight, none above most * source_size.

    What a capped source can't take goes to the others by weight. In the order of most * source_size / weight the
    capped ones come first, so running sums give the level at which the rest is filled. One row for each
    source (the table of sources is ordered in one task: a row of numbers each); sources are counted in the order of their code points, null last.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    fill = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return per.select("source", "source_size", "rows", F.least("cap", F.col("weight") * fill).alias("target"))


def _uniform(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)


def _fold(items: Column, level: int) -> Column:
    """One pass over a block: (carry, done). done: items with their copies, 0 or 1; carry: the one left fractional.

    Two documents at a time, the carry c and the next x, exchange fractional words: c gains what x loses, or the
    other way, as far as one of them gets to 0 or 1. The sum of p * size stays, and the direction is drawn so that
    each p keeps its expectation.
    """

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["down"].alias("down"), x["tie"].alias("tie"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        c = state["carry"]
        cs, cp, xs, xp = c["size"].cast("double"), c["p"], x["size"].cast("double"), x["p"]
        c_room, x_has, c_has, x_room = (1 - cp) * cs, xp * xs, cp * cs, (1 - xp) * xs
        up, down = F.least(c_room, x_has), F.least(c_has, x_room)
        rise = _uniform(F.lit(SEED + level), c["tie"], x["tie"]) * (up + down) <= down
        c_is, x_is = (lambda v: item(c, F.lit(v))), (lambda v: item(x, F.lit(v)))
        moves = [
            (rise & (c_room <= x_has), c_is(1.0), item(x, xp - c_room / xs)),
            (rise, x_is(0.0), item(c, cp + x_has / cs)),
            (c_has <= x_room, c_is(0.0), item(x, xp + c_has / xs)),
        ]
        done, carry = x_is(1.0), item(c, cp - x_room / cs)
        for test, d, k in reversed(moves):
            done, carry = F.when(test, d).otherwise(done), F.when(test, k).otherwise(carry)
        carry = item(carry, F.least(F.greatest(carry["p"], F.lit(0.0)), F.lit(1.0)))
        return F.struct(carry.alias("carry"), F.array_append(state["done"], done).alias("done"))

    first = F.element_at(items, 1)
    start = F.struct(item(first, first["p"]).alias("carry"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, step)


def mix(docs: DataFrame, ws: Workspace, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs (doc_id, text, source; others are ignored).

    The copies of a document are the whole part of target / source_size, and the fraction rounded up or down by the
    pivotal method, in blocks of about BLOCK documents, whose carries are rounded in the next level, until each
    source has one carry, drawn by its fraction. Each source's words so differ from its target by less than that one
    document. Draws are hashes of doc_id, size and the number of a repeated row: runs agree. A document without words takes no part (copies 0),
    rows of one doc_id are rounded each for itself (those of one source and size are numbered, so that many of them, or many without doc_id, are many
    blocks), null sources are one source, the last. No rows, no result. A long text is one number here.
    """
    sized = ws.put(sized_rows(docs), "sized")
    most_rows = sized.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    per = ws.put(targets(sized, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = numbered(sized, most_rows)
    parts = parts.join(per.withColumnRenamed("source", "of"), parts["source"].eqNullSafe(F.col("of"))).drop("of").withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    settled = parts.where(~open_).select("doc_id", "source", "size", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).cast("long").alias("copies"))
    live = parts.where(open_).select("source", F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK)).alias("blocks"), "whole", F.struct((-F.col("size")).alias("down"), F.xxhash64("doc_id", "size", "k").alias("tie"), "doc_id", "size", "p").alias("item"))
    blocks, n_rows = per.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    blocks, level, done = max(1, -(-blocks // BLOCK)), 0, [settled]
    live = live.withColumn("at", F.pmod(F.col("item.tie"), "blocks"))
    while True:
        level += 1
        folded = live.groupBy("source", "at").agg(F.max("whole").alias("whole"), F.max("blocks").alias("blocks"), F.array_sort(F.collect_list("item")).alias("items"))
        folded = ws.put(folded.select("source", "at", "whole", "blocks", _fold(F.col("items"), level).alias("x")).select("source", "at", "whole", "blocks", "x.*"), f"fold_{level}", n_rows if level == 1 else n_rows // BLOCK, 20_000)
        out = folded.select("source", "whole", F.explode("done").alias("item"))
        done.append(out.select("item.doc_id", "source", "item.size", (F.col("whole") + F.col("item.p")).cast("long").alias("copies")))
        if blocks == 1:
            break
        blocks = -(-blocks // BLOCK)
        fewer = F.greatest(F.lit(1), F.ceil(F.col("blocks") / BLOCK))
        live = folded.select("source", "whole", fewer.alias("blocks"), F.col("carry").alias("item"), F.pmod(F.xxhash64(F.lit(level), "at"), fewer).alias("at"))
    last = F.when(_uniform(F.lit(SEED), "carry.tie") < F.col("carry.p"), 1).otherwise(0)
    done.append(folded.select("carry.doc_id", "source", "carry.size", (F.col("whole") + last).cast("long").alias("copies")))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    out = every.join(per.withColumnRenamed("source", "of"), every["source"].eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "copies")
    return ws.finish(out, n_rows)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; same columns.

    Rows that share their doc_id (or have none) are told apart by source and words, and by their order where these are equal too, so that
    each is taken as often as the mix says for one of them.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixed")
    copies = mix(docs, Workspace(spark, "mix"), weights, most)
    per = ws.put(copies.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("copies").alias("n")), "per", docs.count())
    once = per.where("rows = 1 and doc_id is not null and n > 0").select(F.col("doc_id").alias("__mix_id"), F.col("n").cast("int").alias("__mix_n"))
    again = per.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("__mix_id"))
    taken = docs.join(broadcast_if_small(once, once.count()), docs["doc_id"].cast("long") == F.col("__mix_id")).select(*(docs[c] for c in docs.columns), "__mix_n")
    n_again = again.count()
    if n_again:
        few = broadcast_if_small(again, n_again)
        row = docs.join(few, docs["doc_id"].cast("long").eqNullSafe(F.col("__mix_id")), "left_semi").select(
            F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs["doc_id"].cast("long").alias("__id"), docs["source"].cast("string").alias("__source"), n_words(docs["text"].cast("string")).alias("__size")
        )
        keys = ["__id", "__source", "__size"]
        numbers = Window.partitionBy(*keys)
        row = row.withColumn("__k", F.row_number().over(numbers.orderBy(F.xxhash64(F.to_json("__row")))))
        counted = copies.join(few, copies["doc_id"].eqNullSafe(F.col("__mix_id")), "left_semi").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies")
        counted = counted.withColumn("__k", F.row_number().over(numbers.orderBy("copies"))).select(*(F.col(c).alias(f"{c}2") for c in [*keys, "__k"]), F.col("copies").cast("int").alias("__mix_n"))
        same = F.col("__k") == F.col("__k2")
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
        taken = taken.unionByName(row.join(counted, same).where("__mix_n > 0").select("__row.*", "__mix_n"))
    return taken.withColumn("__mix_k", F.explode(F.array_repeat(F.lit(1), F.col("__mix_n")))).drop("__mix_k", "__mix_n")
