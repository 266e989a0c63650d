"""Mixing sources to target weights by distributed prefix sums.

Every document gets a hash-random key. Within its source, documents are ordered by key in ordered buckets
(the key's leading bits, so buckets are even whatever the source's size); totals of the earlier buckets
are added to each bucket's own running sum, and the source is cut where the sum meets its budget. A budget
beyond the source's size takes whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.llm.common import fresh, words
from pairscope.session import cut_lineage

#: Documents in a bucket, on average; one bucket is sorted in one task.
BUCKET_ROWS = 1_000


def word_sizes(text_col: str = "text") -> Column:
    return F.size(words(text_col)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Columns source, source_size, target from one row per source (source, source_size).

    Sources in code-point order, null last, take the weights in turn and divide ``share`` of all sizes. A target
    stops at ``most`` times its source's size and the excess is shared again by weight: with r = most * size / weight,
    the capped sources are those whose r is below the level at which the rest exhausts what is left.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("double"))
    cap = F.lit(float(most)) * F.col("source_size")
    by_ratio = Window.orderBy("r", F.col("source").asc_nulls_last())
    upto, everything = by_ratio.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0))
    ranked = weighted.withColumn("cap", cap).withColumn("r", F.col("cap") / F.col("w"))
    ranked = ranked.withColumns({
        "capped": F.sum("cap").over(upto), "used": F.sum("w").over(upto),
        "all_w": F.sum("w").over(everything), "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
    })
    # with all sources of lower ratio at their caps, the rest stands at this level; a source is capped if its ratio is not above it
    before = (F.col("budget") - (F.col("capped") - F.col("cap"))) / (F.col("all_w") - F.col("used") + F.col("w"))
    ranked = ranked.withColumns({"full": F.col("r") <= before, "before": before})
    last = F.max(F.when(~F.col("full"), F.struct(-F.col("r"), F.col("before")))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * last.getField("before"))
    return ranked.select("source", "source_size", F.least(F.col("cap"), target).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix", row_col: str | None = None,
) -> DataFrame:
    """One row per input row: <id_col>, size, source_size, target, copies, taken, and <row_col> if one is given.

    ``copies`` is how often the mix holds the document, ``taken`` = copies * size. The last document of a source
    goes in if its middle lies within the budget, so a source misses its target by half a document at most. Null sources
    are one source, the last. Null texts have size 0; documents of size 0 take part in whole epochs and in the cut like
    others and take no words. Repeated identifiers share a key and are cut in order of size, then of ``row_col``, a column
    that tells rows apart. An empty table gives no rows.
    """
    row = ["row"] if row_col else []
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_sizes(text_col).alias("size"), key.alias("key"),
        *[F.col(row_col).alias("row") for _ in row]))
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut_lineage(targets(source, weights, share, most))
    # the number of buckets follows the rows, as a power of two
    rows = sized.agg(F.count("*").alias("n")).select(
        F.pow(F.lit(2), F.least(F.ceil(F.log2(F.greatest(F.col("n") / F.lit(BUCKET_ROWS), F.lit(1.0)))), F.lit(20))).cast("bigint").alias("b"))
    lead = F.conv(F.substring("key", 1, 5), 16, 10).cast("bigint")
    placed = sized.withColumn("bucket", F.floor(lead * rows.scalar() / F.lit(16**5)))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).select(
        offsets["source"].alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    run = placed.withColumn("run", F.sum("size").over(inside))
    placed = run.join(offsets, run["source"].eqNullSafe(F.col("s")) & (run["bucket"] == F.col("b"))).withColumn("upto", F.col("run") + F.col("offset"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - epochs * F.col("source_size")
    copies = (epochs + (2 * F.col("upto") - F.col("size") < 2 * left).cast("bigint")).cast("bigint")
    return placed.withColumn("copies", F.least(copies, F.lit(int(most)))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *[F.col("row").alias(row_col) for _ in row])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as the mix holds them: repeated for each copy, with all their columns.

    Rows are numbered first, so that those of one identifier, or without one, are taken each by its own plan.
    """
    row, copies, copy = fresh(docs, "_row", "_copies", "_copy")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = mix(numbered, id_col, text_col, source_col, row_col=row, **options).where("copies > 0")
    joined = numbered.join(plan.select(F.col(row), F.col("copies").alias(copies)), row)
    repeated = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return repeated.select(*docs.columns)
