"""Deletion rules that look only at the sequence and one snapshot of the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairscope.operators.agreement import CANONICAL
from pairscope.operators.metrics import PAIR, RECORD, pair_metrics, summarize, with_prf

# fixed values: conditions and the rules they apply
CONDITION_RULES = {
    "ORIGINAL": (),
    "R1": ("R1",),
    "R2": ("R2",),
    "R3": ("R3",),
    "R1_R2": ("R1", "R2"),
    "R1_R3": ("R1", "R3"),
}


def rule_triggers(features: DataFrame) -> DataFrame:
    """(record, pair, rule) from topology features: singletons, two-pair stems, non-canonical outer pairs."""
    n, pos = F.col("n_pairs"), F.col("pos")
    trimmed = (n >= 3) & (pos == 0) & ~F.col("pair_type").isin(*CANONICAL) & F.col("inward_pair_type").isin(*CANONICAL)
    rule = F.array_compact(F.array(F.when(n == 1, F.lit("R1")), F.when(n == 2, F.lit("R2")), F.when(trimmed, F.lit("R3"))))
    return features.select(*RECORD, *PAIR, F.explode(rule).alias("rule"))


def rule_edits(triggers: DataFrame) -> DataFrame:
    """One row per (condition, deleted pair) with the rules that chose it."""
    table = F.explode(F.array(*[
        F.struct(F.lit(c).alias("condition"), F.array(*[F.lit(r) for r in rules]).cast("array<string>").alias("rules"))
        for c, rules in CONDITION_RULES.items()]))
    return (
        triggers.withColumn("_c", table).where(F.array_contains("_c.rules", F.col("rule")))
        .groupBy(F.col("_c.condition").alias("condition"), *RECORD, *PAIR)
        .agg(F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("rules"))
    )


def rule_refine(predicted: DataFrame, edits: DataFrame) -> DataFrame:
    """Predictions left under each condition."""
    conditions = F.explode(F.array(*[F.lit(c) for c in CONDITION_RULES])).alias("condition")
    return predicted.select(conditions, *RECORD, *PAIR).join(
        edits.select("condition", *RECORD, *PAIR), ["condition", *RECORD, *PAIR], "left_anti")


def rule_outcomes(records: DataFrame, truth: DataFrame, predicted: DataFrame, edits: DataFrame) -> DataFrame:
    """Summary by condition and source with deltas to ORIGINAL and an outcome label.

    Pairs are compared once; a condition's counts are those of the original less the deleted pairs.
    """
    original = pair_metrics(records, truth, predicted).select(*RECORD, "tp", "fp", "fn")
    known = truth.select("rna_id", *PAIR, F.lit(1).alias("_true"))
    lost = edits.join(known, ["rna_id", *PAIR], "left").groupBy("condition", *RECORD).agg(
        F.count("_true").alias("lost_tp"), F.count_if(F.col("_true").isNull()).alias("lost_fp"))
    conditions = F.explode(F.array(*[F.lit(c) for c in CONDITION_RULES])).alias("condition")
    after = original.select("*", conditions).join(lost, ["condition", *RECORD], "left").fillna(0, ["lost_tp", "lost_fp"])
    metrics = with_prf(after.select(
        "condition", *RECORD, (F.col("tp") - F.col("lost_tp")).alias("tp"), (F.col("fp") - F.col("lost_fp")).alias("fp"),
        (F.col("fn") + F.col("lost_tp")).alias("fn")))
    rows = summarize(metrics, ["condition", "source"])
    base = rows.where("condition = 'ORIGINAL'").select(
        "source", *[F.col(c).alias(f"base_{c}") for c in ("macro_f1", "micro_f1", "sum_tp", "sum_fp")])
    out = rows.join(base, "source").withColumns({
        "delta_macro_f1": F.col("macro_f1") - F.col("base_macro_f1"), "delta_micro_f1": F.col("micro_f1") - F.col("base_micro_f1"),
        "beneficial": F.col("base_sum_fp") - F.col("sum_fp"), "harmful": F.col("base_sum_tp") - F.col("sum_tp")})
    gains = (F.col("delta_macro_f1") > 1e-12) & (F.col("delta_micro_f1") > 1e-12)
    return out.withColumns({
        "benefit_share": F.try_divide(F.col("beneficial").cast("double"), (F.col("beneficial") + F.col("harmful")).cast("double")),
        "outcome": F.when(F.col("condition") == "ORIGINAL", "REFERENCE")
        .when(F.col("beneficial") <= F.col("harmful"), "NO USEFUL SIGNAL").when(gains, "USEFUL SIGNAL").otherwise("TRADE-OFF")})
