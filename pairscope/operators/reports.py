"""Reports over finished summaries, and the accounting identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.functions.ratios import ratio


def error_consolidation(parts: Sequence[DataFrame]) -> DataFrame:
    """One wide row per source from per-source summaries."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "source")
    return out


def rank_patterns(rows: DataFrame, patterns: dict[str, Column], denominator: Column, top: int = 3) -> DataFrame:
    """The ``top`` most frequent error kinds per source within one denominator, ties by name."""
    long = rows.select("source", denominator.alias("d"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("pattern"), c.alias("n")) for n, c in patterns.items()])).alias("p")).select("source", "d", "p.*")
    w = Window.partitionBy("source").orderBy(F.col("rate").desc(), "pattern")  # a few rows per source
    return long.withColumn("rate", ratio(F.col("n"), F.col("d"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def relative_consistency(rates: DataFrame) -> DataFrame:
    """Spread label of a rate over sources: pattern, rate -> label."""
    low, high = F.min("rate"), F.max("rate")
    label = (
        F.when(high == 0, "ABSENT").when(low == 0, "SOURCE_MODEL_SKEWED").when(high / low <= 1.25, "SIMILAR")
        .when(high / low <= 1.75, "MODERATELY_VARIABLE").otherwise("SOURCE_MODEL_SKEWED"))
    return rates.groupBy("pattern").agg(low.alias("low"), high.alias("high"), label.alias("label"))


def event_ratios(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled modification precision, delete recall and preservation of summed counts."""
    s = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp0", "fp0", "lost", "removed")])
    return s.withColumns({
        "modification_precision": ratio(F.col("removed"), F.col("removed") + F.col("lost")), "delete_recall": ratio(F.col("removed"), F.col("fp0")),
        "preservation": ratio(F.col("tp0") - F.col("lost"), F.col("tp0"))})


def accounting_audit(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows that break an identity, by name; empty when every identity holds."""
    out = None
    for name, (rows, holds) in checks.items():
        part = rows.where(~F.coalesce(holds, F.lit(False))).agg(F.count("*").alias("violations")).withColumn("identity", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def runtime_summary(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    c = F.col(column)
    return rows.groupBy(*keys).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))
