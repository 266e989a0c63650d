"""Two iterative graph programs on edge tables: connected components and mutual-best matching.

Each round is a handful of joins and aggregates; the surviving table is checkpointed so a lost
executor repeats one round, not all of them. Loops end when no row changes, not after a fixed count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.session import cut_lineage, fitted


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, component (the smallest node reached). Isolated nodes have no edge, so no row.

    Alternates the large-star and small-star steps, which need O(log n) rounds on any shape of graph.
    Hubs are aggregated map-side (min) and joined back as one row per node.
    """
    def directed(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    stars = cut_lineage(directed(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    # no step makes more edges than there are ends
    size = 2 * stars.count()
    signature = None
    while True:
        # large star: every larger neighbour of u points to the smallest of u's neighbourhood
        stars = fitted(stars, size)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        led = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = fitted(directed(fitted(led, size)), size)
        # small star: u and its smaller neighbours point to the smallest of them
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("u", F.col("m").alias("v")))
        )
        stars = cut_lineage(directed(fitted(small, size)))
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now == signature:
            break
        signature = now
    roots = stars.select(F.col("v").alias("node")).distinct()
    return (
        stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
    )


def mutual_best(edges: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Greedy one-to-one matching under a total order, as rounds of mutually best edges.

    An edge that is best for both of its ends is exactly one that greedy would take next, so the
    union over rounds equals the sequential result. A round removes every edge it touches.
    """
    left, right = list(left), list(right)
    live = cut_lineage(edges.withColumn("_rank", F.struct(*order)))
    taken: DataFrame | None = None
    while not live.isEmpty():
        scored = live.withColumns({
            "_l": F.min("_rank").over(Window.partitionBy(*left)),
            "_r": F.min("_rank").over(Window.partitionBy(*right)),
        })
        chosen = cut_lineage(scored.where((F.col("_rank") == F.col("_l")) & (F.col("_rank") == F.col("_r"))).drop("_l", "_r"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        live = cut_lineage(
            live.join(chosen.select(*left), left, "left_anti").join(chosen.select(*right), right, "left_anti")
        )
    return (taken if taken is not None else live).drop("_rank")
