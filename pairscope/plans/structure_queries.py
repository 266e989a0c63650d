"""Queries on exact comparison, pair errors, separation and stems."""

from pyspark.sql import functions as F

from pairscope.operators import errors, metrics, separation, stems
from pairscope.plans.catalog import query


def pair_text(column: str):
    """Sorted pair array as ``i-j,i-j``."""
    return F.coalesce(F.array_join(F.transform(F.col(column), lambda p: F.concat_ws("-", p["i"], p["j"])), ","), F.lit(""))


@query("e1_pair_status", "rna_id:s source:s i:i j:i status:s")
def _(t):
    return t.status


@query("e2_pair_metrics", "rna_id:s source:s tp:i fp:i fn:i precision:d recall:d f1:d")
def _(t):
    return t.metrics


@query("e3_prf_nullable", "rna_id:s source:s precision:d recall:d f1:d")
def _(t):
    # true singletons are often absent, so undefined ratios really occur
    truth = stems.singleton_pairs(t.truth, ["rna_id"])
    predicted = stems.singleton_pairs(t.predicted, metrics.RECORD)
    counts = metrics.count_status(metrics.pair_status(t.records, truth, predicted), metrics.RECORD, t.records)
    return metrics.with_prf(counts, nullable=True)


@query("e4_summary_by_source",
       "source:s n_samples:i sum_tp:i sum_fp:i sum_fn:i macro_precision:d macro_recall:d macro_f1:d micro_precision:d "
       "micro_recall:d micro_f1:d median_f1:d std_f1:d min_f1:d max_f1:d")
def _(t):
    return metrics.summarize(t.metrics, ["source"])


@query("e5_partition_export", "rna_id:s source:s tp_pairs:s fp_pairs:s fn_pairs:s")
def _(t):
    out = metrics.partition_export(t.status, t.records)
    return out.withColumns({c: pair_text(c) for c in ("tp_pairs", "fp_pairs", "fn_pairs")})


@query("e6_threshold_decode_metrics", "rna_id:s source:s tp:i fp:i fn:i precision:d recall:d f1:d")
def _(t):
    scores = t.pair_events.select("rna_id", "source", "i", "j", (1 - F.col("risk")).alias("score"))
    # half of the scores sit in the lower triangle
    flipped = scores.withColumns({
        "i": F.when(F.col("i") % 2 == 0, F.col("j")).otherwise(F.col("i")),
        "j": F.when(F.col("i") % 2 == 0, F.col("i")).otherwise(F.col("j")),
    })
    return metrics.older_metrics(t.records, t.truth, metrics.threshold_decode(flipped, 0.5))


@query("e7_metric_reproduction", "source:s n:i precision_equal:i recall_equal:i f1_equal:i all_equal:i unmatched:i")
def _(t):
    # the stored table misses every record whose F1 is zero and holds four decimals
    stored = t.metrics.where("f1 > 0").select(
        "rna_id", "source", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])
    decoded = metrics.threshold_decode(
        t.pair_events.select("rna_id", "source", "i", "j", (1 - F.col("risk")).alias("score")), 0.4)
    return metrics.metric_reproduction(stored, metrics.older_metrics(t.records, t.truth, decoded))


@query("e8_strata_metrics", "level:s value:s tp:i fp:i precision:d mean_risk:d")
def _(t):
    keep = F.count_if(F.col("label_delete") == 0)
    drop = F.count_if(F.col("label_delete") == 1)
    return metrics.strata(
        t.pair_events, ["source", "fold", "partition"],
        {"tp": keep, "fp": drop, "precision": keep / (keep + drop), "mean_risk": F.avg("risk")})


@query("r1_wrong_partner_events", "rna_id:s source:s i:i j:i degree:i endpoints:s links:s")
def _(t):
    out = errors.wrong_partner_events(t.status, t.truth)
    return out.withColumns({"endpoints": F.array_join("conflict_endpoints", ","), "links": pair_text("links")})


@query("r2_missing_pair_annotations", "rna_id:s source:s i:i j:i degree:i endpoints:s links:s")
def _(t):
    out = errors.missing_pair_annotations(t.status, t.predicted)
    return out.withColumns({"endpoints": F.array_join("conflict_endpoints", ","), "links": pair_text("links")})


@query("r3_pair_error_table", "rna_id:s source:s error_type:s i:i j:i wrong_partner:i degree:i links:s")
def _(t):
    return t.pair_errors.withColumn("links", pair_text("links"))


@query("r4_pair_error_summary",
       "source:s n_samples:i missing_pairs:i false_pairs:i wrong_partner_pairs:i pure_false_pairs:i linked_missing_pairs:i "
       "pure_missing_pairs:i degree1:i degree2:i samples_with_wrong_partner:i")
def _(t):
    return errors.pair_error_summary(t.pair_errors, t.records)


@query("d1_pair_separation", "rna_id:s i:i j:i separation:i relative_separation:d")
def _(t):
    return t.truth_separation


@query("d2_separation_bins", "bin:s pairs:i")
def _(t):
    return t.truth_separation.groupBy(
        separation.bin_of(F.col("relative_separation")).alias("bin")).agg(F.count("*").alias("pairs"))


@query("d3_separation_quantiles", "variable:s level:d quantile:d")
def _(t):
    return separation.quantiles(t.truth_separation)


@query("d3_price_quantiles", "flag:s level:d quantile:m")
def _(t):
    from pairscope.functions.running import grouped_quantiles
    prices = t.raw("lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return grouped_quantiles(prices, ["flag"], "l_extendedprice", separation.LEVELS)


@query("d4_candidate_binnings", "definition:s bin_index:i pair_count:i rna_count:i")
def _(t):
    return separation.candidate_binnings(t.truth_separation)


@query("d5_pair_inventory", "rna_id:s source:s role:s i:i j:i status:s separation:i relative_separation:d bin:s")
def _(t):
    return separation.pair_inventory(t.status, t.rnas)


@query("d6_errors_by_separation",
       "source:s bin:s tp:i fp:i fn:i precision:d recall:d f1:d fp_share:d fn_share:d")
def _(t):
    return separation.errors_by_separation(t.status, t.rnas, t.records)


@query("d7_wrong_partner_by_separation",
       "source:s bin:s fp:i wrong_partner:i pure_fp:i wrong_share_in_bin:d wrong_share_of_source:d pure_share_of_source:d")
def _(t):
    return separation.wrong_partner_by_separation(
        errors.false_pair_annotations(t.status, t.truth), t.rnas, t.records)


@query("d8_stem_separation_profile",
       "source:s state:s role:s stem_count:i stem_pair_count:i mean_raw:d median_raw:d min_raw:d max_raw:d "
       "mean_relative:d median_relative:d min_relative:d max_relative:d")
def _(t):
    return separation.stem_separation_profile(t.stem_states.where("state <> 'ambiguous'"), t.rnas)


@query("t1_strict_stems", "rna_id:s source:s left_start:i left_end:i right_start:i right_end:i n_pairs:i pairs:s")
def _(t):
    rows = stems.stem_pairs(t.predicted, metrics.RECORD).where("n_pairs >= 2")
    keys = [*metrics.RECORD, "left_start", "left_end", "right_start", "right_end", "n_pairs"]
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("pairs"))
    return out.withColumn("pairs", pair_text("pairs"))


@query("t2_singleton_pairs", "rna_id:s source:s i:i j:i")
def _(t):
    return stems.singleton_pairs(t.predicted, metrics.RECORD)


@query("t3_stem_inventory",
       "rna_id:s source:s pair_count:i stem_count:i stem_pair_count:i singleton_count:i mean_length:d median_length:d "
       "max_length:i lengths:s")
def _(t):
    return stems.stem_inventory(stems.structure_chains(t.truth, t.predicted), stems.structures(t.records))


@query("t4_stem_summary",
       "source:s n_structures:i total_pairs:i total_stems:i total_stem_pairs:i total_singletons:i fraction_in_stems:d "
       "mean_length:d median_length:d max_length:i")
def _(t):
    return stems.stem_summary(stems.structure_chains(t.truth, t.predicted), stems.structures(t.records))


STEM_EDGE = ("rna_id:s source:s t_left_start:i t_right_end:i p_left_start:i p_right_end:i pair_overlap:i pair_union:i "
             "left_overlap:i right_overlap:i displacement:i")


@query("t5_stem_relations", STEM_EDGE)
def _(t):
    return t.relations


@query("t6_stem_candidates", STEM_EDGE + " t_degree:i p_degree:i")
def _(t):
    return t.candidates


@query("t7_stem_candidate_variants",
       "source:s variant:s edges:i t_stems:i p_stems:i t_multi:i p_multi:i t_max_degree:i p_max_degree:i")
def _(t):
    return stems.stem_candidate_variants(t.relations)


@query("t8_ambiguous_components", "rna_id:s source:s component_id:s role:s left_start:i right_end:i")
def _(t):
    return stems.ambiguous_components(t.candidates)


@query("t9_stem_matches",
       "rna_id:s source:s t_left_start:i t_right_end:i p_left_start:i p_right_end:i state:s boundary:s")
def _(t):
    return stems.stem_matches(t.candidates)


@query("t10_stem_residuals", "rna_id:s source:s state:s left_start:i right_end:i n_pairs:i")
def _(t):
    return stems.stem_residuals(t.records, t.truth, t.predicted, t.candidates)


@query("t11_stem_error_table",
       "rna_id:s source:s event_type:s truth_outer:s pred_outer:s pair_overlap:i left_overlap:i right_overlap:i "
       "displacement:i boundary:s component_id:s")
def _(t):
    return stems.stem_error_table(t.records, t.truth, t.predicted, t.candidates_once)


@query("t12_stem_error_summary",
       "source:s n_samples:i truth_stems:i predicted_stems:i exact:i stem_truncation:i stem_extension:i stem_shift:i "
       "isolated_complex_mismatch:i ambiguous_truth_stems:i ambiguous_predicted_stems:i ambiguous_components:i "
       "stem_missing:i unmatched_predicted:i fraction_exact:d fraction_missing:d fraction_unmatched:d")
def _(t):
    return stems.stem_error_summary(t.stem_states, stems.ambiguous_components(t.candidates_once), t.records)


@query("t13_stem_greedy_match", "rna_id:s source:s t_left_start:i t_right_end:i p_left_start:i p_right_end:i pair_overlap:i")
def _(t):
    return stems.stem_greedy_match(t.candidates)


@query("t14_fp_stem_attribution",
       "source:s fp_total:i fp_exact:i fp_truncation:i fp_extension:i fp_shift:i fp_complex:i fp_ambiguous:i "
       "fp_unmatched:i fp_outside:i")
def _(t):
    return stems.fp_stem_attribution(t.status, t.predicted, t.stem_states)
