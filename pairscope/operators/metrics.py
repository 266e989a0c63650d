"""Exact comparison of predicted pairs with true pairs, and its summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pairscope.functions.ratios import exact_prf, nullable_prf

RECORD = ["rna_id", "source"]
PAIR = ["i", "j"]


def true_pairs_per_record(records: DataFrame, truth: DataFrame) -> DataFrame:
    """One copy of an RNA's true pairs for each of its records."""
    return truth.join(records.select(*RECORD), "rna_id").select(*RECORD, *PAIR)


def pair_status(records: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """TP, FP, FN row for every pair of a record; one shuffle on the full pair key."""
    sides = (
        true_pairs_per_record(records, truth).select("*", F.lit(1).alias("t"), F.lit(0).alias("p"))
        .unionByName(predicted.select(*RECORD, *PAIR, F.lit(0).alias("t"), F.lit(1).alias("p")))
    )
    return (
        sides.groupBy(*RECORD, *PAIR).agg(F.max("t").alias("t"), F.max("p").alias("p"))
        .select(
            *RECORD, *PAIR,
            F.when((F.col("t") == 1) & (F.col("p") == 1), "TP").when(F.col("p") == 1, "FP").otherwise("FN").alias("status"),
        )
    )


def count_status(status: DataFrame, keys: Sequence[str], records: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn per key; with ``records`` every record key appears, pairs or not."""
    rows = status.select(*keys, "status")
    if records is not None:
        rows = rows.unionByName(records.select(*keys, F.lit(None).cast("string").alias("status")))
    return rows.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("TP", "FP", "FN")]
    )


def with_prf(counts: DataFrame, prefix: str = "", nullable: bool = False) -> DataFrame:
    """Add precision, recall, f1 computed from tp, fp, fn."""
    convention = nullable_prf if nullable else exact_prf
    p, r, f = convention(*[F.col(f"{prefix}{c}") for c in ("tp", "fp", "fn")])
    return counts.withColumns({f"{prefix}precision": p, f"{prefix}recall": r, f"{prefix}f1": f})


def pair_metrics(records: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return with_prf(count_status(pair_status(records, truth, predicted), RECORD, records))


def summarize(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro, micro and F1 distribution over records. F1 takes few distinct values, so the exact median is cheap."""
    sums = metrics.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        *[F.sum(c).alias(f"sum_{c}") for c in ("tp", "fp", "fn")],
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        F.percentile("f1", 0.5).alias("median_f1"), F.stddev_pop("f1").alias("std_f1"),
        F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"),
    )
    p, r, f = exact_prf(F.col("sum_tp"), F.col("sum_fp"), F.col("sum_fn"))
    return sums.withColumns({"micro_precision": p, "micro_recall": r, "micro_f1": f})


def partition_export(status: DataFrame, records: DataFrame) -> DataFrame:
    """Sorted TP/FP/FN pair arrays per record."""
    def pairs(code: str):
        return F.array_sort(F.collect_list(F.when(F.col("status") == code, F.struct(*PAIR))))

    return records.select(*RECORD).join(
        status.groupBy(*RECORD).agg(*[pairs(s).alias(f"{s.lower()}_pairs") for s in ("TP", "FP", "FN")]), RECORD, "left"
    )


def threshold_decode(scores: DataFrame, cutoff: float) -> DataFrame:
    """Pairs scored above the cutoff in either triangle."""
    return (
        scores.where((F.col("score") > cutoff) & (F.col("i") != F.col("j")))
        .select(*RECORD, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    )


def older_metrics(records: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Record metrics under the older convention: empty against empty scores 0."""
    counts = count_status(pair_status(records, truth, predicted), RECORD, records)
    zero = [F.coalesce(c, F.lit(0.0)) for c in nullable_prf(F.col("tp"), F.col("fp"), F.col("fn"))]
    return counts.withColumns(dict(zip(("precision", "recall", "f1"), zero)))


def metric_reproduction(stored: DataFrame, recomputed: DataFrame, digits: int = 4) -> DataFrame:
    """How many stored (rounded) record metrics equal the recomputed ones, by source."""
    s, r = stored.alias("s"), recomputed.alias("r")
    joined = s.join(r, RECORD, "full_outer")
    equal = {c: F.round(F.col(f"r.{c}"), digits) == F.col(f"s.{c}") for c in ("precision", "recall", "f1")}
    return joined.groupBy("source").agg(
        F.count("*").alias("n"),
        *[F.count_if(e).alias(f"{c}_equal") for c, e in equal.items()],
        F.count_if(equal["precision"] & equal["recall"] & equal["f1"]).alias("all_equal"),
        F.count_if(F.col("s.f1").isNull() | F.col("r.f1").isNull()).alias("unmatched"),
    )


def strata(events: DataFrame, dimensions: Sequence[str], measures: dict) -> DataFrame:
    """The same measures pooled and per value of each single dimension, in one pass."""
    sets = [[]] + [[F.col(d)] for d in dimensions]
    level = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions], F.lit("pooled"))
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dimensions], F.lit("all"))
    return events.groupingSets(sets, *dimensions).agg(
        level.alias("level"), value.alias("value"), *[m.alias(n) for n, m in measures.items()]
    )
