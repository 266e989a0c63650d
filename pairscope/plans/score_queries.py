"""Queries on agreement features, rules, reliability metrics and threshold search."""

from pyspark.sql import functions as F

from pairscope.operators import agreement, reliability, rules, thresholds
from pairscope.operators.metrics import PAIR, RECORD, exact_prf
from pairscope.plans.catalog import query
from pairscope.sources.derived import SOURCES


def labelled(t):
    """Scored pairs with support and topology features."""
    features = agreement.topology_features(t.predicted, t.rnas)
    events = agreement.support(t.pair_events)
    return features.join(events.select(*RECORD, *PAIR, "fold", "partition", "label_delete", "risk", "gt_pair_count", "support"), [*RECORD, *PAIR])


def scored(t):
    return agreement.support(t.pair_events)


@query("f1_support_other_count", "rna_id:s source:s i:i j:i support:i support_risk:i")
def _(t):
    return agreement.support(t.predicted)


@query("f2_agreement_features",
       "rna_id:s source:s i:i j:i support:i support_by_src_a:i support_by_src_b:i support_by_src_c:i any_support:i all_agree:i agree_i:i "
       "agree_j:i conflict_i:i conflict_j:i any_conflict:i inward_support:i outward_support:i stem_full_support:i stem_fraction:d")
def _(t):
    return agreement.agreement_features(t.predicted, SOURCES)


@query("f3_support_enrichment", "stratum:s support:i n:i deletes:i delete_share:d base_rate:d enrichment:d monotonic:i")
def _(t):
    return agreement.support_enrichment(scored(t))


@query("f4_condition_potential", "source:s condition:s n:i deletes:i keeps:i")
def _(t):
    features = agreement.agreement_features(t.predicted, SOURCES)
    return agreement.condition_potential(features.join(t.pair_events.select(*RECORD, *PAIR, "label_delete"), [*RECORD, *PAIR]))


@query("f5_topology_features",
       "rna_id:s source:s i:i j:i base_i:s base_j:s pair_type:s raw_separation:i relative_separation:d singleton_flag:i "
       "strict_stem_length:i stem_pair_position:i normalized_stem_position:d outer_boundary_flag:i inner_boundary_flag:i "
       "outward_neighbor_exists:i inward_neighbor_exists:i outward_pair_type:s inward_pair_type:s")
def _(t):
    return agreement.topology_features(t.predicted, t.rnas)


@query("f6_encode_candidate", "feature:s total:d")
def _(t):
    encoded = agreement.encode_candidate(labelled(t).withColumn("pair_probability", 1 - F.col("risk")))
    names = [c for c in encoded.columns if c not in (*RECORD, *PAIR)]
    sums = encoded.agg(*[F.sum(F.col(f"`{n}`").cast("double")).alias(f"c{k}") for k, n in enumerate(names)])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"c{k}").alias("total")) for k, n in enumerate(names)])).alias("x")).select("x.*")


@query("f7_label_balance", "source:s n:i keeps:i deletes:i delete_fraction:d rnas:i rnas_with_delete:i")
def _(t):
    return agreement.label_balance(t.pair_events)


@query("f8_feature_balance", "dimension:s value:s n:i deletes:i delete_fraction:d")
def _(t):
    return agreement.feature_balance(labelled(t))


@query("f9_pair_class", "source:s pair_class:s n:i deletes:i")
def _(t):
    return labelled(t).groupBy("source", agreement.pair_class(F.col("pair_type")).alias("pair_class")).agg(
        F.count("*").alias("n"), F.sum("label_delete").alias("deletes"))


@query("f10_standardize", "rna_id:s source:s i:i j:i raw_separation:d relative_separation:d strict_stem_length:d")
def _(t):
    columns = ["raw_separation", "relative_separation", "strict_stem_length"]
    rows = labelled(t)
    fitted = agreement.standardize_fit(rows.where("`partition` = 'train'"), columns)
    return agreement.standardize_apply(rows, fitted, columns, usable=F.col("singleton_flag") == 0)


@query("f11_harm_profile", "dimension:s value:s deletions:i harmful:i beneficial:i harm_share:d benefit_share:d")
def _(t):
    return agreement.harm_profile(labelled(t).where("risk >= 0.5"))


@query("x1_rule_triggers", "rna_id:s source:s i:i j:i rule:s")
def _(t):
    return rules.rule_triggers(agreement.topology_features(t.predicted, t.rnas))


@query("x2_rule_refine", "condition:s rna_id:s source:s i:i j:i")
def _(t):
    edits = rules.rule_edits(rules.rule_triggers(agreement.topology_features(t.predicted, t.rnas)))
    return rules.rule_refine(t.predicted, edits)


@query("x2_rule_edits", "condition:s rna_id:s source:s i:i j:i rules:s")
def _(t):
    return rules.rule_edits(rules.rule_triggers(agreement.topology_features(t.predicted, t.rnas)))


@query("x3_rule_outcomes",
       "condition:s source:s sum_tp:i sum_fp:i sum_fn:i macro_f1:d micro_f1:d delta_macro_f1:d delta_micro_f1:d beneficial:i harmful:i "
       "benefit_share:d outcome:s")
def _(t):
    edits = rules.rule_edits(rules.rule_triggers(agreement.topology_features(t.predicted, t.rnas)))
    return rules.rule_outcomes(t.records, t.truth, t.predicted, edits)


@query("m1_average_precision", "rna_id:s n_events:i positives:i average_precision:d")
def _(t):
    return reliability.ranking_metrics(t.item_events, ["rna_id"])


@query("m2_auroc", "rna_id:s auroc:d")
def _(t):
    return reliability.ranking_metrics(t.item_events, ["rna_id"])


@query("m3_brier", "rna_id:s brier:d")
def _(t):
    return t.item_events.groupBy("rna_id").agg(reliability.brier(F.col("score"), F.col("label")).alias("brier"))


@query("m4_ece_bins", "bin_index:i n:i weight:d mean_score:d observed:d gap:d contribution:d")
def _(t):
    return reliability.ece_bins(t.pair_events, [], "risk", "label_delete")


@query("m5_reliability_pooled", "n_events:i positives:i prevalence:d average_precision:d auroc:d brier:d ece:d")
def _(t):
    return reliability.reliability(t.item_events)


@query("m5_reliability_by_group",
       "groups:i prevalence:d prevalence_defined:i average_precision:d average_precision_defined:i auroc:d auroc_defined:i brier:d "
       "brier_defined:i ece:d ece_defined:i")
def _(t):
    return reliability.balanced_reliability(reliability.reliability(t.pair_events, ["rna_id"], "risk", "label_delete"))


@query("m6_prevalence_baseline",
       "rotation:i stratum:s n_test:i constant_score:d average_precision:d auroc:d brier:d ece:d")
def _(t):
    return reliability.prevalence_baseline(t.pair_events)


@query("m7_bpp_risk", "rna_id:s source:s i:i j:i risk:d")
def _(t):
    scores = t.pair_events.where(F.col("source") == SOURCES[0]).select("rna_id", *PAIR, (1 - F.col("risk")).alias("score"))
    return reliability.bpp_risk(t.predicted, scores, ["rna_id", *PAIR])


def document_events(t):
    return t.raw("labels").join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", F.col("lang").alias("source"), F.col("toxic").alias("label_delete"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


@query("m8_delete_classification", "source:s tp:i fp:i fn:i precision:d recall:d f1:d")
def _(t):
    return reliability.delete_classification(document_events(t), F.col("score") >= 0.5, ["source"], "label_delete")


@query("m9_delete_classification_by_feature", "dimension:s value:s tp:i fp:i fn:i precision:d recall:d f1:d")
def _(t):
    rows = agreement.by_dimension(labelled(t), agreement.diagnostic_dimensions(), reliability.delete_counts(F.col("label_delete"), F.col("risk") >= 0.5))
    p, r, f = exact_prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.withColumns({"precision": p, "recall": r, "f1": f})


UTILITY = "tp0:i fp0:i fn0:i lost:i removed:i " + " ".join(f"{m}:d" for m in thresholds.RATIOS)


@query("u1_deletion_utility_event", "source:s contexts:i " + UTILITY)
def _(t):
    return thresholds.deletion_utility(thresholds.context_counts(t.pair_events, F.col("risk") >= 0.5, RECORD), ["source"])[0]


@query("u1_deletion_utility_balanced", "source:s rnas:i " + " ".join(f"{m}:d {m}_defined:i" for m in thresholds.RATIOS))
def _(t):
    return thresholds.deletion_utility(thresholds.context_counts(t.pair_events, F.col("risk") >= 0.5, RECORD), ["source"])[1]


# the balanced measures are long running sums: six decimals
CURVE = ("threshold:d eligible:i event_tp_preservation:d event_fp_removal:d event_modification_precision:d deleted:i "
         "balanced_tp_preservation:m balanced_fp_removal:m balanced_modification_precision:m")


def validated(t):
    """Scored pairs with the rotation whose validation fold they are in: the fold after the rotation's test fold."""
    return t.pair_events.withColumn("rotation", (F.col("fold") + 4) % 5)


@query("u2_threshold_curve", "rotation:i " + CURVE)
def _(t):
    return thresholds.threshold_curve(validated(t), "risk", keys=["rotation"])


@query("u2_item_curve", CURVE)
def _(t):
    return thresholds.threshold_curve(t.item_events.withColumnRenamed("label", "label_delete"), "score")


@query("u3_threshold_select", "rotation:i " + CURVE)
def _(t):
    return thresholds.threshold_select(thresholds.threshold_curve(validated(t), "risk", keys=["rotation"]), ["rotation"])


@query("u4_grid_threshold_select", "threshold:d f1:d deleted:i tp_preservation:d")
def _(t):
    return thresholds.grid_threshold_select(thresholds.grid_points(t.pair_events, "risk"))


@query("u4_grid_points", "source:s threshold:d tp:i fp:i fn:i precision:d recall:d f1:d tp_preservation:d deleted:i")
def _(t):
    return thresholds.grid_points(document_events(t), "score", ["source"])


@query("u5_source_conditional_thresholds", "source:s threshold:d f1:d deleted:i tp_preservation:d deployable:i")
def _(t):
    return thresholds.source_conditional_thresholds(thresholds.grid_points(t.pair_events, "risk", ["source"]))


@query("u6_apply_threshold", "source:s threshold:d n:i deleted:i")
def _(t):
    chosen = thresholds.grid_threshold_select(thresholds.grid_points(t.pair_events, "risk", ["source"]), ["source"])
    return thresholds.apply_threshold(t.pair_events, "risk", chosen, ["source"]).groupBy("source", "threshold").agg(
        F.count("*").alias("n"), F.count_if("deleted").alias("deleted"))


@query("u7_consensus_veto", "source:s rule:s deleted:i harmful:i vetoed:i")
def _(t):
    passes = F.col("risk") >= 0.5
    rules = {"score": passes, "consensus_veto": thresholds.consensus_veto(F.col("risk"), F.lit(0.5), F.col("support")),
             "zero_support": thresholds.zero_support(F.col("support"))}
    sums = scored(t).groupBy("source").agg(*[F.struct(
        F.count_if(c).alias("deleted"), F.count_if(c & (F.col("label_delete") == 0)).alias("harmful"), F.count_if(passes & ~c).alias("vetoed")).alias(n)
        for n, c in rules.items()])
    return sums.select("source", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), *[F.col(f"{n}.{c}").alias(c) for c in ("deleted", "harmful", "vetoed")]) for n in rules])).alias("x")).select("source", "x.*")


@query("u7_recalibrated_veto", "threshold:d f1:d deleted:i tp_preservation:d")
def _(t):
    return thresholds.grid_threshold_select(thresholds.grid_points(scored(t), "risk", veto=F.col("support") < 2))


@query("u14_structure_effect",
       "source:s records:i macro_before:d macro_after:d macro_delta:d micro_delta:d modified:i lost:i removed:i delete_recall:d tp_preservation:d")
def _(t):
    return thresholds.structure_effect(t.pair_events, F.col("risk") >= 0.6)


def runs(t):
    """F1 of three cutoffs on each (fold, source) as conditions and runs."""
    cut = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(c).alias("cut")) for n, c in (("low", 0.4), ("mid", 0.55), ("high", 0.7))]))
    rows = t.pair_events.withColumn("_c", cut).select("*", "_c.condition", "_c.cut")
    return reliability.delete_classification(rows, F.col("risk") >= F.col("cut"), ["condition", "fold", "source"], "label_delete")


@query("u15_paired_conditions", "condition:s pairs:i mean_difference:d up:i down:i")
def _(t):
    return thresholds.paired_conditions(runs(t), ["fold", "source"], "f1", "mid")


@query("u16_run_distribution", "condition:s runs:i mean:d std:d median:d min:d max:d")
def _(t):
    return thresholds.run_distribution(runs(t), ["condition"], "fold", "f1")


@query("u16_order_distribution", "priority:s runs:i mean:d std:d median:d min:d max:d")
def _(t):
    orders = t.raw("orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("run"),
                                    (F.col("o_totalprice") / 100000.0).alias("value"))
    return thresholds.run_distribution(orders, ["priority"], "run", "value")


BASELINES = ("risk_high", "risk_low", "no_support", "weak_support")


def baseline_rows(t):
    """Scored pairs once per baseline, with its score and what it deletes."""
    rule = dict(zip(BASELINES, (F.col("risk") >= 0.7, F.col("risk") >= 0.45, thresholds.zero_support(F.col("support")), F.col("support") < 2)))
    tagged = scored(t).withColumn("baseline", F.explode(F.array(*[F.lit(n) for n in rule])))
    deleted = F.lit(False)
    for name, condition in rule.items():
        deleted = F.when(F.col("baseline") == name, condition).otherwise(deleted)
    score = F.when(F.col("baseline").startswith("risk"), F.col("risk")).otherwise((2 - F.col("support")) / 2)
    return tagged.withColumns({"deleted": deleted, "baseline_score": score})


def baselines(t, keys=()):
    """(event-pooled, RNA-balanced) utility per baseline and key."""
    return thresholds.deletion_utility(thresholds.context_counts(baseline_rows(t), F.col("deleted"), ["baseline", *RECORD]), ["baseline", *keys])


@query("u19_strongest_baseline",
       "status:s baseline:s eligible_baselines:i rna_fp_removal:d rna_modification_precision:d rna_average_precision:d rna_tp_preservation:d "
       "tp_preservation:d deleted:i source_dependence:s")
def _(t):
    def both(keys):
        event, balanced = baselines(t, keys)
        on = ["baseline", *keys]
        return event.select(*on, "tp_preservation", (F.col("lost") + F.col("removed")).alias("deleted")).join(
            balanced.select(*on, *[F.col(c).alias(f"rna_{c}") for c in ("tp_preservation", "fp_removal", "modification_precision", "delta_f1")]), on)

    ranked = reliability.ranking_metrics(baseline_rows(t), ["baseline", "rna_id"], "baseline_score", "label_delete")
    precision = ranked.groupBy("baseline").agg(F.avg("average_precision").alias("rna_average_precision"))
    return thresholds.strongest_baseline(both([]).join(precision, "baseline"), both(["source"]))


@query("u21_edits_by_support", "stratum:s support:i deletions:i beneficial:i harmful:i precision:d harm_share:d benefit_share:d")
def _(t):
    return thresholds.edits_by_support(scored(t), F.col("risk") >= 0.5)


@query("u22_deployability", "model:s scope:s runs:i usable:i")
def _(t):
    rows = scored(t).withColumn("model", F.explode(F.array(F.lit("score"), F.lit("score_with_veto"))))
    return thresholds.deployability(rows, "risk", ["fold"], ["model"], veto=(F.col("model") == "score") | (F.col("support") < 2))
