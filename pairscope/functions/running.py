"""Running totals and exact quantiles that never put one group into one task.

Rows are split into ordered buckets inside each group. A window totals each bucket
on its own, and the totals of the earlier buckets (a small table) are added back by a
join. Bucket edges are coordinates, or quantiles that are written down first, so a
recomputed task always puts a row into the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.session import cut_lineage

COORDINATE_BUCKET = 4096
#: Values of a bucket, about; buckets of one group go no finer than this many quantiles.
BUCKET_ROWS = 1 << 16
FINEST = 4096


def coordinate_bucket(position: str = "i") -> Column:
    """Bucket of a dense integer coordinate; a bucket holds at most 4096 positions."""
    return F.floor(F.col(position) / F.lit(COORDINATE_BUCKET))


def value_buckets(df: DataFrame, value: str, group: Sequence[str] = (), bucket: str = "_bucket") -> DataFrame:
    """Add an ordered bucket number for an arbitrary numeric column inside each group.

    Groups of more than ``BUCKET_ROWS`` values get as many buckets as that asks for, at quantiles of their own: mergeable
    sketches of those groups only, written down before they are used, so a recomputed task splits in the same places.
    Smaller groups are one bucket.
    """
    group = list(group)
    known = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    sizes = known.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET_ROWS)
    sizes = cut_lineage(sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_n"))
    if sizes.isEmpty():
        return df.withColumn(bucket, F.lit(0))

    def same(rows: DataFrame) -> Column:
        return reduce(and_, [rows[g].eqNullSafe(F.col(f"_g_{g}")) for g in group], F.lit(True))

    ranks = F.array(*[F.lit(k / FINEST) for k in range(1, FINEST)])
    step = F.greatest(F.floor(F.lit(FINEST) * BUCKET_ROWS / F.col("_n")), F.lit(1)).cast("int")
    large = known.join(sizes, same(known)) if group else known.withColumn("_n", sizes.scalar())
    keys = [f"_g_{g}" for g in group]
    drawn = large.groupBy(*keys, "_n").agg(F.kll_sketch_agg_double("_v").alias("_s")).select(
        *keys, step.alias("_step"), F.kll_sketch_get_quantile_double("_s", ranks).alias("_q"))
    edges = cut_lineage(drawn.select(*keys, F.array_distinct(F.filter("_q", lambda q, k: (k + 1) % F.col("_step") == 0)).alias("_edges")))
    # one row per large group
    placed = df.join(edges, same(df), "left").drop(*keys) if group else df.withColumn("_edges", edges.scalar())
    number = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0))
    return placed.withColumn(bucket, F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(number)).drop("_edges")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str | Column],
    bucket: str = "_bucket",
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``{new_name: column}`` in ``order`` within ``group``.

    ``bucket`` must be monotone in ``order``. With ``descending`` both run from high to low;
    the order columns are then plain names.
    """
    group = list(group)
    sums = {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    work = df
    for name, column in sums.items():
        work = work.withColumn(f"_in_{name}", column)

    def directed(column: str | Column) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        return column.desc() if descending else column.asc()

    inside = (
        Window.partitionBy(*group, bucket).orderBy(*[directed(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = work.groupBy(*group, bucket).agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    before = (
        Window.partitionBy(*group).orderBy(directed(bucket))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *group, bucket,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    for name in sums:
        work = work.withColumn(f"_w_{name}", F.sum(f"_in_{name}").over(inside))
    joined = work.join(_null_safe(offsets, group + [bucket]), _null_safe_on(work, group + [bucket]), "left")
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_w_{name}") + F.col(f"_o_{name}"))
    return joined.drop(*[f"{p}_{n}" for n in sums for p in ("_in", "_w", "_o")], *[f"_k_{k}" for k in group + [bucket]])


def cumulative_at(points: DataFrame, queries: DataFrame, group: Sequence[str], position: str, sums: Sequence[str]) -> DataFrame:
    """Sums of the points at or before each position, and the nearest points: one row per position of points and queries.

    Columns group..., position, the sums, ``below`` (largest point at or before), ``above`` (smallest point after). Points may
    share a position. Work is linear in points and queries, and no group is one task.
    """
    group, sums = list(group), list(sums)
    both = points.select(*group, position, *sums, F.col(position).alias("_at")).unionByName(
        queries.select(*group, position, *[F.lit(0).alias(s) for s in sums], F.lit(None).cast("bigint").alias("_at")))
    rows = both.groupBy(*group, position).agg(*[F.sum(s).alias(f"_p_{s}") for s in sums], F.max("_at").alias("_at")).withColumn(
        "_bucket", coordinate_bucket(position))
    totals = running_totals(rows, group, [position], {s: f"_p_{s}" for s in sums})
    ends = rows.groupBy(*group, "_bucket").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    over = Window.partitionBy(*group).orderBy("_bucket")
    sides = ends.select(
        *[F.col(g).alias(f"_k_{g}") for g in group], F.col("_bucket").alias("_k_bucket"),
        F.max("_high").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_low").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(position)
    marked = totals.withColumns({
        "_below": F.max("_at").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_above": F.min("_at").over(inside.rowsBetween(1, Window.unboundedFollowing))})
    joined = marked.join(sides, [*[marked[g].eqNullSafe(F.col(f"_k_{g}")) for g in group], marked["_bucket"] == F.col("_k_bucket")])
    return joined.select(*group, position, *sums, F.coalesce("_below", "_before").alias("below"), F.coalesce("_above", "_after").alias("above"))


def _null_safe(df: DataFrame, keys: list[str]) -> DataFrame:
    for key in keys:
        df = df.withColumnRenamed(key, f"_k_{key}")
    return df


def _null_safe_on(df: DataFrame, keys: list[str]) -> list[Column]:
    return [df[key].eqNullSafe(F.col(f"_k_{key}")) for key in keys]


def grouped_quantiles(df: DataFrame, group: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group: columns group..., level, quantile.

    Values are counted first, so ties cost one row; ranks come from running totals, and a
    quantile is read from the (at most two) values whose rank range covers its position.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(value_buckets(counts, value, group), group, [value], {"_upto": "_n"})
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    # one size row per group; without groups it is a scalar subquery, not a join
    sized = ranked.join(sizes, group) if group else ranked.withColumn("_size", sizes.scalar())
    from_rank, to_rank = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def position(level: Column) -> Column:
        return level * (F.col("_size") - 1)

    hit = F.filter(
        F.array(*[F.lit(float(level)) for level in levels]),
        lambda q: F.floor(position(q)).between(from_rank, to_rank) | F.ceil(position(q)).between(from_rank, to_rank),
    )
    hits = (
        sized.select(*group, F.col(value).cast("double").alias("_v"), "_upto", "_n", "_size", F.explode(hit).alias("level"))
        .withColumn("_pos", position(F.col("level")))
    )
    low = F.max(F.when(F.floor("_pos").between(from_rank, to_rank), F.col("_v")))
    high = F.max(F.when(F.ceil("_pos").between(from_rank, to_rank), F.col("_v")))
    return (
        hits.groupBy(*group, "level", "_pos").agg(low.alias("_a"), high.alias("_b"))
        .select(*group, "level",
                (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))).alias("quantile"))
    )
