"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costloom.session import stage


def _hook(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v). Every node's least neighbour is an aggregate with map-side combine,
    so a node with very many neighbours is never gathered; the join back is one that AQE can split."""
    if large:
        around = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select(F.col("u"), F.col("m").alias("v"))
        moved = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own)
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes with an edge; component is the least node reachable.

    `edges` has two long columns, a and b, in any direction and with repeats. Each round is written to the
    shared checkpoint folder: lineage stays short and a lost executor rereads files. Ends when a round
    changes nothing, where every node points at the least node of its component. Nulls and loops are
    ignored; no edges give no rows.
    """
    now = stage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        now = stage(_hook(_hook(now, True), False), name)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
