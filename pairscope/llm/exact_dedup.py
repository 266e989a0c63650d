"""Exact deduplication by a content sort.

Rows are range-partitioned by the first bytes of the normalised text and its hash (Spark samples the
splitters), each partition is sorted by the whole text (external sort, spilling), and neighbours are
compared in full. A group of equal texts that is larger than half a mean partition is dealt out under
several salts, sorted and compared under each of them, and one representative of each salt is
compared in full again, so no group lies in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pairscope.llm.common import fresh, partitions
from pairscope.session import cut_lineage

#: Bytes of the text that the sampled splitters hold, so the sample stays small when texts are long.
PREFIX = 48


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest" identifier of each group of equal texts. A null text counts as
    the empty text; a null identifier is smaller than all others. Rows that repeat an identifier inside
    a group are all marked kept when that identifier stays. An empty table gives no rows; further
    columns of ``docs`` are ignored. ``docs`` should be a scan or a checkpointed table: rows of a large
    group are spread by their place in it.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("text"))
    base = base.select("id", "text", F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("text").alias("hash"))

    # hashes of at least 1/(2 * partitions) of the rows; there can be no more than 2 * partitions of them
    counts = base.groupBy("hash").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    hot = cut_lineage(
        counts.withColumn("share", F.floor(total.scalar() / (2 * parts)) + 1).where("n > share")
        .select("hash", F.ceil(F.col("n") / F.col("share")).cast("int").alias("salts"))
    )
    # by place in the input, for rows that repeat an identifier, or have none, must spread too
    row_salt = F.when(F.col("salts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id", "row"), F.col("salts")).cast("int"))
    dealt = (
        base.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), "hash", "left").withColumn("salt", row_salt).drop("salts", "row")
        .repartitionByRange(parts, "prefix", "hash", "salt")
    )
    place = ["prefix", "hash", "salt"]
    in_order = Window.partitionBy(*place).orderBy("text", "id")
    heads = dealt.withColumn("before", F.lag("text").over(in_order)).withColumn(
        "head", F.col("before").isNull() | (F.col("before") != F.col("text")))
    runs = heads.select(
        "id", *place, F.sum(F.col("head").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.sha2("text", 256).alias("sha"), F.when(F.col("head") & (F.col("salt") > 0), F.col("text")).alias("text"))
    run = Window.partitionBy(*place, "run")
    local = cut_lineage(runs.withColumns({"best": _best(keep, "id", run), "n": F.count("*").over(run)}).drop("prefix"))

    # one representative per salt and run of the large groups, compared in full once more
    whole = Window.partitionBy("hash").orderBy("text")
    summary = local.where("text IS NOT NULL").select("hash", "salt", "run", "text", "best", "n")
    summary = summary.withColumn("head", F.coalesce(F.lag("text").over(whole) != F.col("text"), F.lit(True)))
    summary = summary.withColumn("g", F.sum(F.col("head").cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("hash", "g")
    merged = summary.select(
        F.col("hash"), F.col("salt"), F.col("run"), _best(keep, "best", group).alias("all_best"), F.sum("n").over(group).alias("all_n"))
    final = local.drop("text").join(merged, ["hash", "salt", "run"], "left")
    large = F.col("all_n").isNotNull()
    keep_id = F.when(large, F.col("all_best")).otherwise(F.col("best"))
    return final.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))


def _best(keep: str, name: str, group: WindowSpec) -> Column:
    """Smallest or largest identifier of a window, a null being the smallest of all."""
    if keep == "largest":
        return F.max(name).over(group)
    return F.when(F.count("*").over(group) == F.count(name).over(group), F.min(name).over(group))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated as a whole, one stays.

    Two rows with one identifier and different texts are different documents.
    """
    kept = exact_groups(docs, id_col, text_col, keep).where("kept").select(_key(id_col).alias("k"), F.col("text_sha256").alias("s"))
    key, sha = fresh(docs, "_key", "_sha")
    marked = docs.withColumns({key: _key(id_col), sha: F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
    kept = kept.select(F.col("k").alias(f"{key}k"), F.col("s").alias(f"{sha}k"))
    staying = marked.join(kept, (marked[key] == kept[f"{key}k"]) & (marked[sha] == kept[f"{sha}k"]), "left_semi")
    return staying.dropDuplicates([key, sha]).drop(key, sha)


def _key(id_col: str) -> Column:
    """The identifier as a text that is never null, so plain equality joins it."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))
