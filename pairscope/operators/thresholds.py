"""Utility of deletions and constrained threshold search.

``events`` carry rna_id, source, label_delete, gt_pair_count and a context key; label 1 is a false pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.functions.ratios import mean_and_defined, nullable_prf, ratio
from pairscope.functions.running import running_totals, value_buckets
from pairscope.operators.metrics import exact_prf
from pairscope.session import cut_lineage

MINIMUM_PRESERVATION = 0.99
# fixed values: the published grid and the names of the utility ratios
GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)

COUNTS = ("tp0", "fp0", "fn0", "lost", "removed")
RATIOS = ("tp_preservation", "fp_removal", "modification_precision", "coverage", "resulting_precision", "resulting_recall",
          "resulting_f1", "original_precision", "original_recall", "original_f1", "delta_f1")


def context_counts(events: DataFrame, deleted: Column, context: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per context: true and false pairs before, and how many of each are deleted. ``rna_id`` is always kept."""
    keys = list(dict.fromkeys(["rna_id", *context, *keep]))
    label = F.col("label_delete")
    counts = events.groupBy(*keys).agg(
        F.count_if(label == 0).alias("tp0"), F.count_if(label == 1).alias("fp0"),
        F.count_if((label == 0) & deleted).alias("lost"), F.count_if((label == 1) & deleted).alias("removed"),
        F.max("gt_pair_count").alias("_gt"))
    return counts.withColumn("fn0", F.col("_gt") - F.col("tp0")).drop("_gt")


def utility_ratios(counts: DataFrame) -> DataFrame:
    tp0, fp0, fn0, lost, removed = [F.col(c) for c in COUNTS]
    p0, r0, f0 = nullable_prf(tp0, fp0, fn0)
    p1, r1, f1 = nullable_prf(tp0 - lost, fp0 - removed, fn0 + lost)
    return counts.withColumns({
        "tp_preservation": ratio(tp0 - lost, tp0), "fp_removal": ratio(removed, fp0),
        "modification_precision": ratio(removed, lost + removed), "coverage": ratio(lost + removed, tp0 + fp0),
        "resulting_precision": p1, "resulting_recall": r1, "resulting_f1": f1,
        "original_precision": p0, "original_recall": r0, "original_f1": f0, "delta_f1": f1 - f0})


def deletion_utility(contexts: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(event-pooled, RNA-balanced) utility per key; ratios first per RNA, then averaged where defined."""
    keys = list(keys)
    sums = [F.sum(c).alias(c) for c in COUNTS]
    event = utility_ratios(contexts.groupBy(*keys).agg(F.count("*").alias("contexts"), *sums))
    per_rna = utility_ratios(contexts.groupBy(*keys, "rna_id").agg(*sums))
    balanced = per_rna.groupBy(*keys).agg(F.count("*").alias("rnas"), *[c for m in RATIOS for c in mean_and_defined(m)])
    return event, balanced


def threshold_curve(events: DataFrame, score: str, fixed: Column | None = None, swept: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Utility at every distinct score of each key, equal scores together, plus one row per key with a null threshold.

    ``fixed`` rows are deleted at every point and ``swept`` rows (default: the others) by score. Balanced preservation
    and removal are linear, so each event carries its weight 1/(its RNA's total x number of RNAs); balanced
    modification precision is the running sum of each RNA's change at its own score blocks. Keys are groups of one plan.
    """
    if not keys:
        return threshold_curve(events.withColumn("_all", F.lit(0)), score, fixed, swept, ["_all"]).drop("_all")
    keys = list(keys)
    fixed = F.lit(False) if fixed is None else fixed
    swept = ~fixed if swept is None else swept
    label = F.col("label_delete")
    zero = F.lit(None).cast("double")
    # one row per (key, RNA, score); the fixed rows form a block with a null score
    blocks = cut_lineage(
        events.withColumn("_s", F.when(swept, F.col(score).cast("double")).otherwise(zero))
        .groupBy(*keys, "rna_id", "_s").agg(
            F.count_if(label == 0).alias("tp"), F.count_if(label == 1).alias("fp"),
            F.count_if((label == 0) & (swept | fixed)).alias("lost"), F.count_if((label == 1) & (swept | fixed)).alias("removed"),
        ))
    per_rna = blocks.groupBy(*keys, "rna_id").agg(
        F.sum("tp").alias("tp_all"), F.sum("fp").alias("fp_all"),
        F.coalesce(F.sum(F.when(F.col("_s").isNull(), F.col("lost"))), F.lit(0)).alias("lost0"),
        F.coalesce(F.sum(F.when(F.col("_s").isNull(), F.col("removed"))), F.lit(0)).alias("removed0"))
    start_mp = ratio(F.col("removed0"), F.col("lost0") + F.col("removed0"))
    totals = cut_lineage(per_rna.groupBy(*keys).agg(
        F.sum("tp_all").alias("tp"), F.sum("fp_all").alias("fp"), F.count_if(F.col("tp_all") > 0).alias("r_tp"),
        F.count_if(F.col("fp_all") > 0).alias("r_fp"), F.sum("lost0").alias("lost0"), F.sum("removed0").alias("removed0"),
        F.coalesce(F.sum(ratio(F.col("lost0"), F.col("tp_all"))), F.lit(0.0)).alias("wl0"),
        F.coalesce(F.sum(ratio(F.col("removed0"), F.col("fp_all"))), F.lit(0.0)).alias("wr0"),
        F.coalesce(F.sum(start_mp), F.lit(0.0)).alias("mp0"), F.count(start_mp).alias("def0"),
    ))
    group = [*keys, "rna_id"]
    moving = value_buckets(blocks.where("_s IS NOT NULL"), "_s", group)
    inside = running_totals(moving, group, ["_s"], {"cl": "lost", "cr": "removed"}, descending=True).join(per_rna, group)
    now_l, now_r = F.col("cl") + F.col("lost0"), F.col("cr") + F.col("removed0")
    was = ratio(now_r - F.col("removed"), now_l + now_r - F.col("lost") - F.col("removed"))
    by_score = cut_lineage(inside.groupBy(*keys, "_s").agg(
        F.sum("lost").alias("lost"), F.sum("removed").alias("removed"),
        F.coalesce(F.sum(ratio(F.col("lost"), F.col("tp_all"))), F.lit(0.0)).alias("wl"),
        F.coalesce(F.sum(ratio(F.col("removed"), F.col("fp_all"))), F.lit(0.0)).alias("wr"),
        F.sum(ratio(now_r, now_l + now_r) - F.coalesce(was, F.lit(0.0))).alias("dmp"),
        F.count_if(was.isNull()).alias("ddef")))
    curve = running_totals(
        value_buckets(by_score, "_s", keys), keys, ["_s"],
        {"k_lost": "lost", "k_removed": "removed", "k_wl": "wl", "k_wr": "wr", "k_mp": "dmp", "k_def": "ddef"}, descending=True)
    names = ["k_lost", "k_removed", "k_wl", "k_wr", "k_mp", "k_def"]
    points = curve.select(*keys, F.col("_s").alias("threshold"), *names).unionByName(
        totals.select(*keys, F.lit(None).cast("double").alias("threshold"), *[F.lit(0).cast("double").alias(n) if n in ("k_wl", "k_wr", "k_mp")
                                                                          else F.lit(0).cast("bigint").alias(n) for n in names]))
    T = points.join(totals.select(*keys, F.struct(*[c for c in totals.columns if c not in keys]).alias("t")), keys)
    lost, removed = F.col("k_lost") + F.col("t.lost0"), F.col("k_removed") + F.col("t.removed0")
    balanced_tp = 1 - ratio(F.col("k_wl") + F.col("t.wl0"), F.col("t.r_tp"))
    event_tp = 1 - ratio(lost, F.col("t.tp"))
    return T.select(
        *keys, "threshold", event_tp.alias("event_tp_preservation"), ratio(removed, F.col("t.fp")).alias("event_fp_removal"),
        ratio(removed, lost + removed).alias("event_modification_precision"), (lost + removed).alias("deleted"),
        balanced_tp.alias("balanced_tp_preservation"),
        ratio(F.col("k_wr") + F.col("t.wr0"), F.col("t.r_fp")).alias("balanced_fp_removal"),
        ratio(F.col("k_mp") + F.col("t.mp0"), F.col("k_def") + F.col("t.def0")).alias("balanced_modification_precision"),
    ).withColumn("eligible", (
        (F.round("event_tp_preservation", 12) >= MINIMUM_PRESERVATION)
        & (F.round("balanced_tp_preservation", 12) >= MINIMUM_PRESERVATION)).cast("int"))


def threshold_select(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key the eligible point with most balanced removal, then precision (null lowest), fewer deletions, higher threshold."""
    key = F.struct(
        F.round("balanced_fp_removal", 12),
        F.coalesce(F.round("balanced_modification_precision", 12), F.lit(float("-inf"))),
        -F.col("deleted"), F.coalesce("threshold", F.lit(float("inf"))))
    rest = [c for c in curve.columns if c not in keys]
    return curve.where("eligible = 1").groupBy(*keys).agg(F.max_by(F.struct(*rest), key).alias("p")).select(*keys, "p.*")


def grid_points(events: DataFrame, score: str, keys: Sequence[str] = (), veto: Column | None = None, label: str = "label_delete") -> DataFrame:
    """DELETE quality at each grid threshold from one pass: a row counts at every grid value up to its score."""
    allowed = F.lit(True) if veto is None else veto
    # bounded expansion: first reduce to (keys, how many grid values the score reaches)
    reach = F.when(allowed, F.size(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: g <= F.col(score)))).otherwise(0)
    small = events.groupBy(*keys, reach.alias("reach")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    rank = F.col("g_rank")
    out = small.select(*keys, "reach", "pos", "neg", F.posexplode(F.array(*[F.lit(g) for g in GRID])).alias("g_rank", "threshold")).groupBy(
        *keys, "threshold").agg(
        F.coalesce(F.sum(F.when(F.col("reach") > rank, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("reach") > rank, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("reach") <= rank, F.col("pos"))), F.lit(0)).alias("fn"), F.sum("neg").alias("_keep"))
    p, r, f = exact_prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({
        "precision": p, "recall": r, "f1": f, "tp_preservation": F.coalesce(1 - ratio(F.col("fp"), F.col("_keep")), F.lit(1.0)),
        "deleted": F.col("tp") + F.col("fp")}).drop("_keep")


def grid_threshold_select(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best DELETE F1 with enough preservation, then higher threshold, fewer deletions; null when none is eligible."""
    ok = F.col("tp_preservation") >= MINIMUM_PRESERVATION
    key = F.when(ok, F.struct(F.col("f1"), F.col("threshold"), -F.col("deleted")))
    best = points.groupBy(*keys).agg(F.max_by(F.when(ok, F.struct("threshold", "f1", "deleted", "tp_preservation")), key).alias("b"))
    return best.select(*keys, "b.threshold", "b.f1", "b.deleted", "b.tp_preservation")


def source_conditional_thresholds(points: DataFrame) -> DataFrame:
    """Grid selection per source; deployable only when every source has a threshold."""
    chosen = grid_threshold_select(points, ["source"])
    every = chosen.agg(F.min(F.col("threshold").isNotNull().cast("int")).alias("d"))
    return chosen.withColumn("deployable", every.scalar())


def apply_threshold(events: DataFrame, score: str, thresholds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``deleted``: score at or above the threshold; a null threshold keeps everything."""
    if keys:
        rows = events.join(thresholds.select(*keys, "threshold"), list(keys), "left")
    else:
        rows = events.withColumn("threshold", thresholds.select("threshold").scalar())
    return rows.withColumn("deleted", F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)))


def consensus_veto(score: Column, threshold: Column, support: Column) -> Column:
    """DELETE only when the score passes and fewer than two other sources agree."""
    return F.coalesce((score >= threshold) & (support < 2), F.lit(False))


def zero_support(support: Column) -> Column:
    """DELETE where no other source agrees."""
    return F.coalesce(support == 0, F.lit(False))


def structure_effect(events: DataFrame, deleted: Column, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Before/after macro and micro F1 (exact convention), delete recall, preservation and modified RNAs."""
    contexts = context_counts(events, deleted, ["rna_id", *keys])
    tp0, fp0, fn0, lost, removed = [F.col(c) for c in COUNTS]
    rows = contexts.withColumns({
        "f0": exact_prf(tp0, fp0, fn0)[2], "f1": exact_prf(tp0 - lost, fp0 - removed, fn0 + lost)[2]})
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("records"), F.avg("f0").alias("macro_before"), F.avg("f1").alias("macro_after"),
        F.count_if(lost + removed > 0).alias("modified"), *[F.sum(c).alias(c) for c in COUNTS])
    before, after = exact_prf(tp0, fp0, fn0)[2], exact_prf(tp0 - lost, fp0 - removed, fn0 + lost)[2]
    return out.withColumns({
        "macro_delta": F.col("macro_after") - F.col("macro_before"), "micro_delta": after - before,
        "delete_recall": ratio(removed, fp0), "tp_preservation": ratio(tp0 - lost, tp0)})


def paired_conditions(runs: DataFrame, keys: Sequence[str], metric: str, baseline: str) -> DataFrame:
    """Differences of a metric to the baseline condition on equal keys: mean and how many go up or down."""
    base = runs.where(F.col("condition") == baseline).select(*keys, F.col(metric).alias("_b"))
    rows = runs.where(F.col("condition") != baseline).join(base, list(keys)).withColumn("_d", F.col(metric) - F.col("_b"))
    return rows.groupBy("condition").agg(
        F.count("_d").alias("pairs"), F.avg("_d").alias("mean_difference"), F.count_if(F.col("_d") > 0).alias("up"),
        F.count_if(F.col("_d") < 0).alias("down"))


def run_distribution(runs: DataFrame, keys: Sequence[str], run: str, metric: str) -> DataFrame:
    """Mean, population std, median, min and max over runs of the per-run mean."""
    per_run = runs.groupBy(*keys, run).agg(F.avg(metric).alias("m"))
    return per_run.groupBy(*keys).agg(
        F.count("m").alias("runs"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"),
        F.percentile("m", 0.5).alias("median"), F.min("m").alias("min"), F.max("m").alias("max"))


def strongest_baseline(overall: DataFrame, by_source: DataFrame) -> DataFrame:
    """The eligible baseline with most RNA-balanced removal, then precision, then average precision (nulls lowest), fewer deletions, first name.

    Both tables have baseline, the event tp_preservation and deleted, and the RNA-balanced ratios with an ``rna_`` prefix;
    ``overall`` has rna_average_precision too. A baseline is eligible where event and RNA-balanced preservation reach the minimum.
    It depends on the source where some source alone is not eligible, or where the sign of the F1 change differs between sources.
    """
    enough = lambda c: F.coalesce(F.round(c, 12) >= MINIMUM_PRESERVATION, F.lit(False))
    eligible = enough("tp_preservation") & enough("rna_tp_preservation")
    low = lambda c: F.coalesce(F.round(c, 12), F.lit(float("-inf")))
    order = F.struct(-F.round("rna_fp_removal", 12), -low("rna_modification_precision"), -low("rna_average_precision"), F.col("deleted"), F.col("baseline"))
    best = overall.where(eligible).agg(F.min_by(F.struct(*overall.columns), order).alias("b"), F.count("*").alias("eligible_baselines"))
    best = best.select("b.*", "eligible_baselines")
    signs = by_source.groupBy("baseline").agg(
        F.max((~eligible).cast("int")).alias("_unsafe"), F.count_distinct(F.col("rna_delta_f1") > 0).alias("_signs"))
    out = best.join(signs, "baseline", "left")
    dependent = (F.col("_unsafe") == 1) | (F.col("_signs") > 1)
    return out.withColumns({
        "status": F.when(F.col("baseline").isNull(), "NO_HIGH_PRESERVATION_ELIGIBLE_BASELINE").otherwise("SELECTED"),
        "source_dependence": F.when(dependent, "SOURCE_DEPENDENT_COMPARATOR").when(
            F.col("baseline").isNotNull(), "NO_SOURCE_SAFETY_FAILURE_AT_0.99")}).drop("_unsafe", "_signs")


def edits_by_support(events: DataFrame, deleted: Column) -> DataFrame:
    """Candidate deletions by support and source (and all sources), with shares of all harm and benefit."""
    rows = events.where(deleted).groupingSets(
        [[F.col("source"), F.col("support")], [F.col("support")]], "source", "support").agg(
        F.coalesce("source", F.lit("ALL")).alias("stratum"), F.count("*").alias("deletions"),
        F.sum("label_delete").alias("beneficial"), F.count_if(F.col("label_delete") == 0).alias("harmful"))
    w = Window.partitionBy("stratum")  # three rows each
    return rows.withColumns({
        "precision": ratio(F.col("beneficial"), F.col("deletions")),
        "harm_share": ratio(F.col("harmful"), F.sum("harmful").over(w)),
        "benefit_share": ratio(F.col("beneficial"), F.sum("beneficial").over(w))})


def deployability(events: DataFrame, score: str, run: Sequence[str], keys: Sequence[str] = (), veto: Column | None = None) -> DataFrame:
    """keys..., scope, runs, usable: runs with a threshold for all sources together (GLOBAL), for each source, and for every source (ALL_SOURCES)."""
    keys, run = list(keys), list(run)
    whole = grid_threshold_select(grid_points(events, score, [*keys, *run], veto), [*keys, *run]).withColumn("scope", F.lit("GLOBAL"))
    single = grid_threshold_select(grid_points(events, score, [*keys, *run, "source"], veto), [*keys, *run, "source"]).withColumn("scope", F.col("source"))
    every = single.groupBy(*keys, *run).agg(F.min(F.when(F.col("threshold").isNull(), 0).otherwise(1)).alias("ok")).select(
        *keys, F.lit("ALL_SOURCES").alias("scope"), "ok")
    rows = whole.unionByName(single, allowMissingColumns=True).select(*keys, "scope", F.col("threshold").isNotNull().cast("int").alias("ok")).unionByName(every)
    return rows.groupBy(*keys, "scope").agg(F.count("*").alias("runs"), F.sum("ok").alias("usable"))
