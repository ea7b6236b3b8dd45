"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, ws: Workspace, a: str = "a", b: str = "b", rows: int | None = None, kind: str = "long") -> DataFrame:
    """(node, component), both of type `kind` (long or string): each node of an edge with the smallest node that it reaches.

    Randomised contraction: in each round every node moves to its neighbour (or itself) of least hash, the edges
    are rewritten to those, and loops and repeats go; the hash changes with the round, so that no order of
    the ids makes long chains slow. Every round is written to the shared folder. Self loops are allowed,
    edges with a null end are ignored, an empty table gives an empty one. rows: how many edges there are at most, if known.
    """
    live = ws.put(
        edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).where("a is not null and b is not null").distinct(),
        "cc_edges_0",
        rows,
    )
    rows = 2 * live.count()
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at = ws.put(nodes.withColumn("root", F.col("node")), "cc_at_0", rows)
    live, step = live.where("a <> b"), 0
    while not live.isEmpty():
        step += 1
        rank = F.struct(F.xxhash64(F.lit(step), "y").alias("h"), F.col("y").alias("y"))
        both = live.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        best = both.groupBy("x").agg(F.min(rank).alias("best")).select("x", F.least(F.col("best"), F.struct(F.xxhash64(F.lit(step), "x").alias("h"), F.col("x").alias("y"))).alias("best"))
        moved = ws.put(best.select("x", F.col("best.y").alias("to")), f"cc_moved_{step}", rows)
        to_a, to_b = (moved.select(F.col("x").alias(k), F.col("to").alias(f"{k}2")) for k in "ab")
        edges_next = live.join(to_a, "a").join(to_b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        live = ws.put(edges_next, f"cc_edges_{step}", rows)
        at = ws.put(at.join(moved.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"cc_at_{step}", rows)
        ws.drop(f"cc_moved_{step}", f"cc_edges_{step - 1}", f"cc_at_{step - 1}")
    return at.join(at.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
