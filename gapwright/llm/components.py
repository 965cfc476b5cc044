"""Connected components of an edge table by alternating star contraction, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._workspace import materialise, release


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node it reaches.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows. Each round links the larger
    neighbours of a node to its smallest neighbour, then the smaller ones; rounds grow with the logarithm of the
    longest chain. Every round is written to the shared folder, so a lost executor repeats one round at most.
    Aggregations combine map-side and the joins are plain shuffled joins, whose hot keys AQE can split.
    """
    table = materialise(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = _digest(table)
    if not seen[0]:
        return table.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = table.unionAll(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every neighbour v > u goes to the smallest of u's neighbourhood
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: u and its smaller neighbours go to the smallest of these
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = materialise(small, "small-star")
        now = _digest(after)
        release(table, large)
        table = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
