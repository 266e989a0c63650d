"""Ranking and calibration metrics of scored events, pooled and balanced over groups.

Events are reduced to one row per (group, score) first: equal scores form one block anyway. Prefix sums over
the blocks run in value buckets, so neither the pooled curve nor a hot group lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairscope.functions.ratios import mean_and_defined, ratio
from pairscope.functions.running import running_totals, value_buckets
from pairscope.operators.metrics import exact_prf


def score_blocks(events: DataFrame, group: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Rows, positives per group and score. A score that is no finite number or a label other than 0 and 1 raises."""
    return events.groupBy(*group, finite(F.col(score)).alias("score")).agg(
        F.count("*").alias("n"), F.sum(binary(F.col(label))).alias("pos"))


def finite(value: Column) -> Column:
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("score is not a finite number")).cast("double")).otherwise(value)


def binary(value: Column) -> Column:
    number = value.cast("bigint")
    return F.when(F.coalesce(number.isin(0, 1), F.lit(False)), number).otherwise(F.raise_error(F.lit("label is not 0 or 1")).cast("bigint"))


def ranking_metrics(events: DataFrame, group: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """average_precision (null without positives) and auroc (null with one class) per group."""
    blocks = value_buckets(score_blocks(events, group, score, label), "score", group)
    ranked = running_totals(blocks, group, ["score"], {"cn": "n", "cp": "pos"}, descending=True)
    neg, cneg = F.col("n") - F.col("pos"), F.col("cn") - F.col("cp")
    sums = ranked.groupBy(*group).agg(
        F.sum("n").alias("n_events"), F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("_ap"),
        F.sum(F.col("pos") * cneg - F.col("pos") * neg * 0.5).alias("_above"),
    )
    p, q = F.col("positives"), F.col("n_events") - F.col("positives")
    return sums.select(
        *group, "n_events", "positives", ratio(p, F.col("n_events")).alias("prevalence"),
        ratio(F.col("_ap"), p).alias("average_precision"), ratio(p * q - F.col("_above"), p * q).alias("auroc"))


def brier(score: Column, label: Column) -> Column:
    return F.avg(F.pow(score - label, F.lit(2)))


def ece_bins(events: DataFrame, group: Sequence[str] = (), score: str = "score", label: str = "label", keep_empty: bool = True) -> DataFrame:
    """Ten bins per group with weight, mean score, observed rate, gap and contribution; bad scores raise."""
    value = F.col(score).cast("double")
    bad = value.isNull() | F.isnan(value) | (value < 0) | (value > 1)
    checked = F.when(bad, F.raise_error(F.lit("score outside [0, 1]")).cast("double")).otherwise(value)
    index = F.least(F.floor(checked * 10), F.lit(9)).cast("int")
    counted = events.groupBy(*group, index.alias("bin_index")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_score"), F.avg(label).alias("observed"))
    totals = counted.groupBy(*group).agg(F.sum("n").alias("total"))
    if keep_empty:
        grid = totals.withColumn("bin_index", F.explode(F.array(*[F.lit(k) for k in range(10)])))
        rows = grid.join(counted, [*group, "bin_index"], "left")
    else:
        rows = counted.join(totals, list(group)) if group else counted.withColumn("total", totals.scalar())
    gap = F.abs(F.col("mean_score") - F.col("observed"))
    return rows.fillna(0, ["n"]).withColumn("weight", F.col("n") / F.col("total")).withColumn("gap", gap).withColumn(
        "contribution", F.coalesce(F.col("weight") * F.col("gap"), F.lit(0.0)))


def reliability(events: DataFrame, group: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Prevalence, average precision, AUROC, Brier score and ECE per group."""
    ece = ece_bins(events, group, score, label, keep_empty=False).groupBy(*group).agg(F.sum("contribution").alias("ece"))
    square = events.groupBy(*group).agg(brier(F.col(score), F.col(label)).alias("brier"))
    ranked = ranking_metrics(events, group, score, label)
    if group:
        return ranked.join(square, list(group)).join(ece, list(group))
    return ranked.withColumns({"brier": square.scalar(), "ece": ece.scalar()})


METRICS = ("prevalence", "average_precision", "auroc", "brier", "ece")


def balanced_reliability(per_group: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each metric over the groups where it is defined, with the number of those groups."""
    columns = [c for m in METRICS for c in mean_and_defined(m)]
    return per_group.groupBy(*keys).agg(F.count("*").alias("groups"), *columns)


def prevalence_baseline(events: DataFrame, folds: int = 5) -> DataFrame:
    """Training prevalence as a constant score: pooled and per source, evaluated on each rotation's test fold."""
    by_fold = events.groupBy("fold", "source").agg(F.count("*").alias("n"), F.sum("label_delete").alias("d"))
    # 5 folds x sources rows from here on
    roles = by_fold.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    test = F.col("fold") == F.col("rotation")
    train = ~test & (F.col("fold") != (F.col("rotation") + 1) % folds)
    both = roles.groupingSets([[F.col("rotation"), F.col("source")], [F.col("rotation")]], "rotation", "source").agg(
        F.coalesce("source", F.lit("ALL")).alias("stratum"),
        F.sum(F.when(train, F.col("d"))).alias("td"), F.sum(F.when(train, F.col("n"))).alias("tn"),
        F.sum(F.when(test, F.col("d"))).alias("ed"), F.sum(F.when(test, F.col("n"))).alias("n_test"))
    p, q = ratio(F.col("td"), F.col("tn")), ratio(F.col("ed"), F.col("n_test"))
    # a constant score is one tie block: AP is the held-out prevalence, AUROC is one half
    return both.select("rotation", "stratum", "n_test", p.alias("constant_score"), q.alias("average_precision"),
                       F.when((q > 0) & (q < 1), 0.5).alias("auroc"),
                       (q * F.pow(1 - p, 2) + (1 - q) * F.pow(p, 2)).alias("brier"), F.abs(p - q).alias("ece"))


def bpp_risk(candidates: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One minus the pair probability; candidates without a score keep a null risk."""
    return candidates.join(scores.select(*keys, "score"), list(keys), "left").withColumn("risk", 1 - F.col("score"))


def delete_counts(label: Column, deleted: Column) -> dict[str, Column]:
    return {"tp": F.count_if(deleted & (label == 1)), "fp": F.count_if(deleted & (label == 0)), "fn": F.count_if(~deleted & (label == 1))}


def delete_classification(events: DataFrame, deleted: Column, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Precision, recall, F1 of the DELETE decision."""
    counts = events.groupBy(*keys).agg(*[c.alias(n) for n, c in delete_counts(F.col(label), deleted).items()])
    p, r, f = exact_prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})
