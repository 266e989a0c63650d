"""Queries on decisions, grouping, learning and reports."""

from pyspark.sql import functions as F

from pairscope.functions.ratios import ratio
from pairscope.operators import errors, grouping, learn, metrics, policy, reports, stems, thresholds
from pairscope.operators.metrics import PAIR, RECORD
from pairscope.plans.catalog import query
from pairscope.plans.evidence_queries import Setup
from pairscope.sources.derived import EVIDENCE_SEEDS, SOURCES


def decided(t, features=None):
    """Scored pairs under each manifest, with scope, two scores and the three-way action at 0.5; ``features`` adds columns to the pairs."""
    pairs = t.pair_events.select(*RECORD, *PAIR, "fold", "label_delete", "risk", "gt_pair_count")
    if features is not None:
        pairs = pairs.join(features, [*RECORD, *PAIR])
    rows = Setup(t).with_scope(pairs).withColumnRenamed("selected", "item_count")
    other = F.when(F.col("i") % 3 == 0, 1 - F.col("risk")).otherwise(F.col("risk"))
    return rows.withColumn("other", other).withColumn("q", policy.corroborated_score(F.col("risk"), F.col("other"))).withColumn(
        "action", policy.three_way_action(F.col("risk"), F.col("other"), F.col("scope"), F.lit(0.5)))


@query("u8_corroborated_score", "manifest_id:s source:s i:i j:i q:d")
def _(t):
    return decided(t)


@query("u9_three_way_actions", "manifest_id:s source:s i:i j:i scope:s action:s")
def _(t):
    return decided(t)


def validated(t):
    """Decided rows with the rotation whose validation fold they are in."""
    return decided(t).withColumn("rotation", validates())


def validates():
    """A fold is the validation part of the rotation before it."""
    return (F.col("fold") + learn.FOLDS - 1) % learn.FOLDS


@query("u10_policy_threshold",
       "rotation:i threshold:d eligible:i event_tp_preservation:d event_fp_removal:d event_modification_precision:d deleted:i "
       "balanced_tp_preservation:m balanced_fp_removal:m balanced_modification_precision:m")
def _(t):
    return policy.policy_curve(validated(t), "q", ["rotation"])


@query("u10_policy_selected", "rotation:i threshold:d eligible:i deleted:i balanced_fp_removal:m balanced_modification_precision:m")
def _(t):
    return policy.policy_threshold(validated(t), "q", ["rotation"])


@query("u11_action_accounting", "channel:s source:s keep:i delete:i abstain:i total:i outside_deletes:i outside_fraction:d tp_preservation:d "
       "fp_removal:d modification_precision:d delta_f1:d")
def _(t):
    return policy.action_accounting(decided(t), ["channel", "source"])


@query("u12_scope_accounting",
       "channel:s scope:s tp:i fp:i lost:i removed:i tp_preservation:d fp_removal:d modification_precision:d coverage:d rnas:i "
       "rna_tp_preservation:d rna_fp_removal:d rna_modification_precision:d rna_coverage:d rna_fp_removal_defined:i delta_f1:d")
def _(t):
    return policy.scope_accounting(decided(t), ["channel"])


@query("u13_evidence_efficiency", "channel:s density:i items:i removed:i removed_per_item:d delta_f1_per_item:d rna_removed_per_item:d "
       "rna_removed_per_item_defined:i rna_delta_f1_per_item:d rna_delta_f1_per_item_defined:i")
def _(t):
    return policy.evidence_efficiency(decided(t), ["channel", "density"])


SIDES = "removed_a removed_b lost_a lost_b only_a_removed only_b_removed only_a_lost only_b_lost".split()


@query("u17_marginal_breakdown", "dimension:s stratum:s n:i tp:i fp:i " + " ".join(f"{c}:i mean_{c}:d" for c in SIDES) + " mean_n:d delta_removed:i delta_lost:i "
       + " ".join(f"{c}_{x}:d" for c in ("tp_preservation", "fp_removal", "modification_precision") for x in "ab"))
def _(t):
    from pairscope.plans.score_queries import labelled
    features = labelled(t).select(*RECORD, *PAIR, "support", "raw_separation", "singleton_flag", "normalized_stem_position", "outer_boundary_flag",
                                  "inner_boundary_flag", "pair_type")
    rows = decided(t, features).withColumns({
        "del_a": F.col("action") == "DELETE", "del_b": F.col("risk") >= 0.6, "risk_a": F.col("other"), "risk_b": F.col("risk")})
    return policy.marginal_breakdown(rows, len(EVIDENCE_SEEDS))


@query("u18_channel_stability", "grouping:i strata:i positive_pair:d unpaired:d pair_wins:i unpaired_wins:i")
def _(t):
    return policy.channel_stability(decided(t))


@query("u20_pareto_compare", "stratum:s weighting:s baseline:s tp_preservation:d fp_removal:d front:i front_both:i")
def _(t):
    from pairscope.plans.score_queries import baselines
    event, balanced = baselines(t, ["source"])
    rows = None
    for name, part in (("event", event), ("rna", balanced)):
        found = policy.pareto(part.select(F.col("source").alias("stratum"), "baseline", "tp_preservation", "fp_removal"), "tp_preservation", "fp_removal")
        found = found.withColumn("weighting", F.lit(name))
        rows = found if rows is None else rows.unionByName(found)
    both = rows.groupBy("stratum", "baseline").agg(F.min("front").alias("front_both"))
    return rows.join(both, ["stratum", "baseline"])


@query("u23_gain_retention", "track:s weighting:s gain:d retention:d")
def _(t):
    delete = {"policy": F.col("action") == "DELETE", "masked": F.col("q") >= 0.5,
              "single": (F.col("risk") >= 0.5) | (F.col("scope") == "LOCAL_CONFLICT")}
    false = F.col("label_delete") == 1
    tracks = decided(t).withColumn("track", F.explode(F.array(F.col("channel"), F.lit("combined"))))
    per_rna = tracks.groupBy("track", "rna_id").agg(F.count_if(false).alias("fp"), *[F.count_if(c & false).alias(n) for n, c in delete.items()])
    values = per_rna.groupBy("track").agg(*[
        F.struct((F.sum(n) / F.sum("fp")).alias("event"), F.avg(ratio(F.col(n), F.col("fp"))).alias("rna")).alias(n) for n in delete])
    long = values.select("track", F.explode(F.array(*[
        F.struct(F.lit(n).alias("condition"), F.lit(w).alias("weighting"), F.col(n)[w].alias("value")) for n in delete for w in ("event", "rna")])).alias("x"))
    return policy.gain_retention(long.select("track", "x.*"), "policy", "masked", "single", ["track", "weighting"])


@query("l4_platt_apply", "rna_id:s source:s i:i j:i p:d raw_cutoff:d")
def _(t):
    a, b = F.lit(1.5), F.lit(-0.25)
    return t.pair_events.withColumn("p", policy.platt_apply(policy.clipped_logit(F.col("risk")), a, b)).withColumn(
        "raw_cutoff", policy.inverse_cutoff(F.lit(0.6), a, b))


@query("l5_masked_control", "scope:s n:i exact:i")
def _(t):
    return policy.masked(decided(t), ["exact", "local"]).groupBy("scope").agg(F.count("*").alias("n"), F.sum("exact").alias("exact"))


@query("l1_fit_delete_risk", "variant:s rotation:i rna_id:s source:s i:i j:i p_delete:d")
def _(t):
    from pairscope.plans.score_queries import labelled
    return learn.fit_delete_risk(labelled(t), ["support", "raw_separation", "strict_stem_length", "singleton_flag"], SOURCES)


@query("l3_platt_fit", "rotation:i a:m b:m calibrated_mean:m")
def _(t):
    rows = t.pair_events.withColumns({"z": policy.clipped_logit(F.col("risk")), "rotation": validates()})
    fitted = learn.platt_fit(rows, "z", "label_delete", ["rotation"])
    return rows.join(fitted, "rotation").groupBy("rotation", "a", "b").agg(
        F.avg(policy.platt_apply(F.col("z"), F.col("a"), F.col("b"))).alias("calibrated_mean"))


def mutated(t):
    """Sequences with one letter set by id, so near copies and exact copies both occur."""
    return t.rnas.select("rna_id", F.overlay(F.col("sequence"), F.lit("A"), (F.col("rna_id").cast("int") % F.col("sequence_length") + 1), F.lit(1)).alias("sequence"))


@query("g1_similar_sequences", "a:s b:s identity:d")
def _(t):
    return grouping.similar_sequences(mutated(t))


@query("g2_identity_components", "component_size:i components:i")
def _(t):
    rows = mutated(t)
    out = grouping.identity_components(rows, grouping.similar_sequences(rows))
    return out.groupBy("component_id").agg(F.count("*").alias("component_size")).groupBy("component_size").agg(F.count("*").alias("components"))


@query("g3_grouped_folds", "fold:i rnas:i components:i")
def _(t):
    rows = mutated(t)
    folds = grouping.grouped_folds(grouping.identity_components(rows, grouping.similar_sequences(rows)))
    return folds.groupBy("fold", "component_id").agg(F.count("*").alias("n")).groupBy("fold").agg(F.sum("n").alias("rnas"), F.count("*").alias("components"))


@query("g4_fold_roles", "rotation:i rna_id:s role:s")
def _(t):
    return grouping.fold_roles(t.folds)


@query("g6_leave_one_source_out", "held_out:s rotation:i rna_id:s source:s role:s")
def _(t):
    return grouping.leave_one_source_out(t.records, grouping.fold_roles(t.folds))


@query("g5_nearest_reference", "rna_id:s identity:d nearest:s reason:s")
def _(t):
    rows = mutated(t)
    d = F.col("rna_id").cast("bigint") % 5
    return grouping.nearest_reference(rows.where(d != 0), rows.where(d == 0))


@query("p1_error_consolidation", "source:s macro_f1:d false_pairs:i wrong_partner_pairs:i total_stems:i fp_total:i fp_extension:i fp_outside:i")
def _(t):
    return reports.error_consolidation([
        metrics.summarize(t.metrics, ["source"]), errors.pair_error_summary(t.pair_errors, t.records),
        stems.stem_summary(stems.structure_chains(t.truth, t.predicted), stems.structures(t.records)),
        stems.fp_stem_attribution(t.status, t.predicted, t.stem_states)])


def patterns(t, top):
    rows = errors.pair_error_summary(t.pair_errors, t.records)
    names = {"missing_pair": F.col("missing_pairs"), "wrong_partner_fp": F.col("wrong_partner_pairs"), "pure_false_positive_pair": F.col("pure_false_pairs")}
    return reports.rank_patterns(rows, names, F.col("missing_pairs") + F.col("false_pairs"), top)


@query("p2_rank_patterns", "source:s rank:i pattern:s n:i rate:d")
def _(t):
    return patterns(t, 3)


@query("p3_relative_consistency", "pattern:s low:d high:d label:s")
def _(t):
    return reports.relative_consistency(patterns(t, 3))


@query("p4_event_ratios", "source:s modification_precision:d delete_recall:d preservation:d")
def _(t):
    return reports.event_ratios(thresholds.context_counts(t.pair_events, F.col("risk") >= 0.65, RECORD), ["source"])


@query("p5_accounting_audit", "identity:s violations:i")
def _(t):
    sizes = t.truth.groupBy("rna_id").agg(F.count("*").alias("truths"))
    predicted = t.predicted.groupBy(*RECORD).agg(F.count("*").alias("predictions"))
    sized = t.metrics.join(sizes, "rna_id").join(predicted, RECORD, "left").fillna(0)
    inventory = stems.stem_inventory(stems.structure_chains(t.truth, t.predicted), stems.structures(t.records))
    links = t.pair_errors.select(*RECORD, "error_type", *PAIR, F.explode("links").alias("l"))
    mirror = links.where("error_type = 'missing_pair'").select(*RECORD, F.col("l.i").alias("i"), F.col("l.j").alias("j"), F.col("i").alias("mi"), F.col("j").alias("mj"), F.lit(1).alias("m"))
    forward = links.where("error_type = 'false_positive_pair'").select(*RECORD, *PAIR, F.col("l.i").alias("mi"), F.col("l.j").alias("mj"), F.lit(1).alias("f"))
    both = forward.join(mirror, [*RECORD, *PAIR, "mi", "mj"], "full_outer")
    return reports.accounting_audit({
        "tp_fn_is_truth": (sized, F.col("tp") + F.col("fn") == F.col("truths")),
        "tp_fp_is_prediction": (sized, F.col("tp") + F.col("fp") == F.col("predictions")),
        "stems_singletons_are_pairs": (inventory, F.col("stem_pair_count") + F.col("singleton_count") == F.col("pair_count")),
        "links_mirror": (both, F.col("m").isNotNull() & F.col("f").isNotNull()),
    })


@query("p6_runtime_summary", "event_type:s n:i total:m mean:d min:d max:d")
def _(t):
    return reports.runtime_summary(t.raw("events"), ["event_type"], "value")


