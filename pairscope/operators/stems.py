"""Stems (maximal stacked chains), their matching between truth and prediction, and error states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.functions.graph import connected_components, mutual_best
from pairscope.functions.ratios import ratio
from pairscope.functions.running import coordinate_bucket, running_totals
from pairscope.operators.metrics import PAIR, RECORD

MINIMUM_STEM_PAIRS = 2


def stem_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every pair with its chain: n_pairs, position in the chain, and the chain's bounds.

    A chain keeps ``i + j`` constant, so chains are islands of consecutive ``i`` inside one
    (structure, register). Even a huge structure spreads over its many registers.
    """
    keys = list(keys)
    register = Window.partitionBy(*keys, "register").orderBy("i")
    island = Window.partitionBy(*keys, "register", "_island")
    return (
        pairs.select(*keys, *PAIR).withColumn("register", F.col("i") + F.col("j"))
        .withColumn("_island", F.col("i") - F.row_number().over(register))
        .withColumns({
            "n_pairs": F.count("*").over(island).cast("int"),
            "left_start": F.min("i").over(island), "left_end": F.max("i").over(island),
            "right_start": F.min("j").over(island), "right_end": F.max("j").over(island),
        })
        .withColumn("pos", F.col("i") - F.col("left_start")).drop("_island")
    )


def strict_stems(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per chain of two or more pairs."""
    return chains(pairs, keys).where(F.col("n_pairs") >= MINIMUM_STEM_PAIRS)


def singleton_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return chains(pairs, keys).where("n_pairs = 1").select(
        *keys, F.col("left_start").alias("i"), F.col("right_end").alias("j"))


def chains(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    register = Window.partitionBy(*keys, "register").orderBy("i")
    return (
        pairs.select(*keys, *PAIR).withColumn("register", F.col("i") + F.col("j"))
        .withColumn("_island", F.col("i") - F.row_number().over(register))
        .groupBy(*keys, "register", "_island").agg(
            F.count("*").cast("int").alias("n_pairs"),
            F.min("i").alias("left_start"), F.max("i").alias("left_end"),
            F.min("j").alias("right_start"), F.max("j").alias("right_end"),
        ).drop("_island")
    )


def structure_chains(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Chains of both roles; truth is counted once per RNA under the source name ``truth``."""
    return chains(
        truth.select("rna_id", F.lit("truth").alias("source"), *PAIR)
        .unionByName(predicted.select("rna_id", "source", *PAIR)), RECORD)


def structures(records: DataFrame) -> DataFrame:
    """Every structure that exists, with or without pairs."""
    return records.select(*RECORD).unionByName(
        records.select("rna_id", F.lit("truth").alias("source")).distinct())


def stem_inventory(chain_rows: DataFrame, structure_rows: DataFrame) -> DataFrame:
    """Pair, stem and singleton counts and stem lengths per structure; zeros when it has none."""
    stem = F.col("n_pairs") >= MINIMUM_STEM_PAIRS
    length = F.when(stem, F.col("n_pairs"))
    ordered = F.array_sort(F.collect_list(F.when(stem, F.struct("left_start", "right_end", "n_pairs"))))
    rows = chain_rows.unionByName(structure_rows, allowMissingColumns=True)
    return rows.groupBy(*RECORD).agg(
        F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("pair_count"), F.count_if(stem).alias("stem_count"),
        F.coalesce(F.sum(length), F.lit(0)).alias("stem_pair_count"),
        F.count_if(F.col("n_pairs") == 1).alias("singleton_count"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.percentile(length, 0.5), F.lit(0.0)).alias("median_length"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_length"),
        F.array_join(F.transform(ordered, lambda s: s["n_pairs"].cast("string")), ",").alias("lengths"),
    )


def stem_summary(chain_rows: DataFrame, structure_rows: DataFrame) -> DataFrame:
    """The same by source, with lengths pooled over stems."""
    stem = F.col("n_pairs") >= MINIMUM_STEM_PAIRS
    length = F.when(stem, F.col("n_pairs"))
    sizes = structure_rows.groupBy("source").agg(F.count("*").alias("n_structures"))
    pooled = chain_rows.groupBy("source").agg(
        F.sum("n_pairs").alias("total_pairs"), F.count_if(stem).alias("total_stems"),
        F.coalesce(F.sum(length), F.lit(0)).alias("total_stem_pairs"),
        F.count_if(F.col("n_pairs") == 1).alias("total_singletons"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.percentile(length, 0.5), F.lit(0.0)).alias("median_length"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_length"),
    )
    out = sizes.join(pooled, "source", "left").fillna(0)
    return out.withColumn(
        "fraction_in_stems", F.coalesce(ratio(F.col("total_stem_pairs"), F.col("total_pairs")), F.lit(0.0)))


def _side(pairs: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    rows = stem_pairs(pairs, keys).where(F.col("n_pairs") >= MINIMUM_STEM_PAIRS)
    return rows.select(*keys, *PAIR, *[
        F.col(c).alias(f"{prefix}_{c}") for c in ("left_start", "left_end", "right_start", "right_end", "n_pairs", "register")
    ])


STEM_COLUMNS = [f"{p}_{c}" for p in ("t", "p")
                for c in ("left_start", "left_end", "right_start", "right_end", "n_pairs", "register")]


def stem_relations(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Overlap of every truth and predicted stem that share an arm position.

    A position opens at most one pair per structure, so arm overlap is a count of equal positions:
    two equi-joins and one aggregate, linear in the pairs, instead of comparing all stems of a record.
    Stems that share nothing have all overlaps zero and no row.
    """
    t, p = _side(truth, ["rna_id"], "t"), _side(predicted, RECORD, "p")
    left = t.withColumnRenamed("j", "tj").join(p.withColumnRenamed("j", "pj"), ["rna_id", "i"]).select(
        *RECORD, *STEM_COLUMNS, F.lit(1).alias("l"), F.lit(0).alias("r"), (F.col("tj") == F.col("pj")).cast("int").alias("x"))
    right = t.drop("i").join(p.drop("i"), ["rna_id", "j"]).select(
        *RECORD, *STEM_COLUMNS, F.lit(0).alias("l"), F.lit(1).alias("r"), F.lit(0).alias("x"))
    return left.unionByName(right).groupBy(*RECORD, *STEM_COLUMNS).agg(
        F.sum("x").cast("int").alias("pair_overlap"),
        F.sum("l").cast("int").alias("left_overlap"), F.sum("r").cast("int").alias("right_overlap"),
    ).withColumns({
        "pair_union": F.col("t_n_pairs") + F.col("p_n_pairs") - F.col("pair_overlap"),
        "displacement": F.col("p_register") - F.col("t_register"),
        "shorter": F.least("t_n_pairs", "p_n_pairs"),
        "min_arm": F.least("left_overlap", "right_overlap"),
    })


# the candidate rules: predicates on a relation without shared pairs but different register
SHIFT_RULES = {
    "exact_only": "false",
    "bilateral_at_least_1": "min_arm >= 1",
    "bilateral_at_least_2": "min_arm >= 2",
    "bilateral_2_and_half_shorter": "min_arm >= 2 AND 2 * min_arm >= shorter",
    "bilateral_all_but_one_shorter": "min_arm >= 2 AND min_arm >= shorter - 1",
    "bilateral_full_shorter": "min_arm >= 2 AND min_arm = shorter",
}
CHOSEN_RULE = "bilateral_all_but_one_shorter"


def _is_candidate(rule: str) -> Column:
    return (F.col("pair_overlap") > 0) | ((F.col("displacement") != 0) & F.expr(SHIFT_RULES[rule]))


TRUTH_STEM = [*RECORD, "t_left_start", "t_right_end"]
PRED_STEM = [*RECORD, "p_left_start", "p_right_end"]


def stem_candidates(relations: DataFrame, rule: str = CHOSEN_RULE) -> DataFrame:
    """Candidate edges with the number of edges at each end; a stem has at most its length in edges."""
    return relations.where(_is_candidate(rule)).withColumns({
        "t_degree": F.count("*").over(Window.partitionBy(*TRUTH_STEM)),
        "p_degree": F.count("*").over(Window.partitionBy(*PRED_STEM)),
    })


def stem_candidate_variants(relations: DataFrame) -> DataFrame:
    """Edge and degree counts of the six candidate rules side by side."""
    tagged = relations.withColumn("variant", F.explode(F.array_compact(F.array(*[
        F.when(_is_candidate(rule), F.lit(rule)) for rule in SHIFT_RULES
    ]))))
    edges = tagged.groupBy("source", "variant").agg(F.count("*").alias("edges"))
    ends = []
    for name, keys in (("t", TRUTH_STEM), ("p", PRED_STEM)):
        degree = tagged.groupBy("variant", *keys).agg(F.count("*").alias("n"))
        ends.append(degree.groupBy("source", "variant").agg(
            F.count("*").alias(f"{name}_stems"), F.count_if(F.col("n") > 1).alias(f"{name}_multi"),
            F.max("n").alias(f"{name}_max_degree")))
    return edges.join(ends[0], ["source", "variant"]).join(ends[1], ["source", "variant"])


def _node(prefix: str) -> Column:
    return F.struct(*[F.col(c) for c in RECORD], F.lit(prefix == "p").alias("predicted"),
                    F.col(f"{prefix}_left_start").alias("a"), F.col(f"{prefix}_right_end").alias("z"))


def ambiguous_components(candidates: DataFrame) -> DataFrame:
    """Stems of components with more than one stem on a side, numbered by first truth stem.

    Truth stems sort before predicted ones, so the component label is its first truth stem.
    """
    tangled = candidates.where("t_degree > 1 OR p_degree > 1")
    members = connected_components(tangled.select(_node("t").alias("a"), _node("p").alias("b")))
    firsts = members.select("component").distinct().select(
        "component", F.col("component.rna_id").alias("rna_id"), F.col("component.source").alias("source"),
        F.col("component.a").alias("i"))
    numbered = running_totals(
        firsts.withColumn("_bucket", coordinate_bucket()), RECORD, ["i"], {"component_number": F.lit(1)})
    number = F.col("component_number").cast("string")  # three digits at least, never cut
    return members.join(numbered.select("component", "component_number"), "component").select(
        F.col("node.rna_id").alias("rna_id"), F.col("node.source").alias("source"),
        F.concat(F.lit("ambiguous_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0"))).alias("component_id"),
        F.when(F.col("node.predicted"), "prediction").otherwise("truth").alias("role"),
        F.col("node.a").alias("left_start"), F.col("node.z").alias("right_end"),
    )


def stem_matches(candidates: DataFrame) -> DataFrame:
    """Isolated one-to-one edges classified by interval containment in the same register."""
    same = F.col("displacement") == 0
    outer_cut = F.col("p_left_start") - F.col("t_left_start")  # > 0: prediction starts further inside
    inner_cut = F.col("t_left_end") - F.col("p_left_end")      # > 0: prediction ends further outside
    inside = same & (outer_cut >= 0) & (inner_cut >= 0)
    around = same & (outer_cut <= 0) & (inner_cut <= 0)
    state = (
        F.when(inside & around, "exact").when(inside, "stem_truncation").when(around, "stem_extension")
        .when(~same & (F.col("pair_overlap") == 0), "stem_shift").otherwise("complex_mismatch")
    )
    bounded = F.col("state").isin("stem_truncation", "stem_extension")
    subtype = (
        F.when(~bounded, "none").when((outer_cut != 0) & (inner_cut != 0), "both")
        .when(outer_cut != 0, "outer").otherwise("inner")
    )
    return candidates.where("t_degree = 1 AND p_degree = 1").withColumn("state", state).withColumn("boundary", subtype)


def stem_residuals(records: DataFrame, truth: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Truth stems without an edge (missing) and predicted stems without one (unmatched)."""
    true_stems = records.select(*RECORD).join(strict_stems(truth, ["rna_id"]), "rna_id")
    missing = true_stems.join(
        candidates.select(*RECORD, F.col("t_left_start").alias("left_start"), F.col("t_right_end").alias("right_end")),
        [*RECORD, "left_start", "right_end"], "left_anti").withColumn("state", F.lit("stem_missing"))
    unmatched = strict_stems(predicted, RECORD).join(
        candidates.select(*RECORD, F.col("p_left_start").alias("left_start"), F.col("p_right_end").alias("right_end")),
        [*RECORD, "left_start", "right_end"], "left_anti").withColumn("state", F.lit("unmatched_predicted_stem"))
    columns = [*RECORD, "state", "left_start", "left_end", "right_start", "right_end", "n_pairs"]
    return missing.select(*columns).unionByName(unmatched.select(*columns))


def stem_states(records: DataFrame, truth: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every stem instance of both roles with the state it ended in."""
    matches = stem_matches(candidates)
    columns = ["left_start", "left_end", "right_start", "right_end", "n_pairs"]
    parts = []
    for role, p in (("truth", "t"), ("prediction", "p")):
        parts.append(matches.select(*RECORD, "state", F.lit(role).alias("role"), *[F.col(f"{p}_{c}").alias(c) for c in columns]))
        tangled = candidates.where("t_degree > 1 OR p_degree > 1")
        parts.append(tangled.select(*RECORD, F.lit("ambiguous").alias("state"), F.lit(role).alias("role"),
                                    *[F.col(f"{p}_{c}").alias(c) for c in columns]).distinct())
    residuals = stem_residuals(records, truth, predicted, candidates)
    parts.append(residuals.withColumn(
        "role", F.when(F.col("state") == "stem_missing", "truth").otherwise("prediction")).select(*RECORD, "state", "role", *columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stem_error_table(records: DataFrame, truth: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Flat events: matches, members of ambiguous components, missing and unmatched stems."""
    def outer(prefix: str) -> Column:
        return F.concat_ws("-", F.col(f"{prefix}left_start"), F.col(f"{prefix}right_end"))

    matched = stem_matches(candidates).select(
        *RECORD, F.col("state").alias("event_type"), outer("t_").alias("truth_outer"), outer("p_").alias("pred_outer"),
        "pair_overlap", "left_overlap", "right_overlap", "displacement", "boundary")
    tangled = ambiguous_components(candidates)
    rest = stem_residuals(records, truth, predicted, candidates)
    for rows, kind, truth_side in (
        (tangled.withColumn("event_type", F.lit("complex_mismatch")), "component_id", F.col("role") == "truth"),
        (rest.withColumn("event_type", F.col("state")), None, F.col("state") == "stem_missing"),
    ):
        part = rows.select(
            *RECORD, "event_type", F.when(truth_side, outer("")).alias("truth_outer"),
            F.when(~truth_side, outer("")).alias("pred_outer"), F.lit("none").alias("boundary"),
            *([F.col(kind)] if kind else []))
        matched = matched.unionByName(part, allowMissingColumns=True)
    return matched


def stem_error_summary(states: DataFrame, components: DataFrame, records: DataFrame) -> DataFrame:
    names = {
        "exact": "exact", "stem_truncation": "stem_truncation", "stem_extension": "stem_extension",
        "stem_shift": "stem_shift", "complex_mismatch": "isolated_complex_mismatch",
    }
    t, p = F.col("role") == "truth", F.col("role") == "prediction"
    counts = states.groupBy("source").agg(
        F.count_if(t).alias("truth_stems"), F.count_if(p).alias("predicted_stems"),
        *[F.count_if(t & (F.col("state") == s)).alias(n) for s, n in names.items()],
        F.count_if(t & (F.col("state") == "ambiguous")).alias("ambiguous_truth_stems"),
        F.count_if(p & (F.col("state") == "ambiguous")).alias("ambiguous_predicted_stems"),
        F.count_if(F.col("state") == "stem_missing").alias("stem_missing"),
        F.count_if(F.col("state") == "unmatched_predicted_stem").alias("unmatched_predicted"),
    )
    tangles = (
        components.groupBy(*RECORD).agg(F.count_distinct("component_id").alias("n"))
        .groupBy("source").agg(F.sum("n").alias("ambiguous_components"))
    )
    samples = records.groupBy("source").agg(F.count("*").alias("n_samples"))
    out = samples.join(counts, "source", "left").join(tangles, "source", "left").fillna(0)
    return out.withColumns({
        "fraction_exact": F.coalesce(ratio(F.col("exact"), F.col("truth_stems")), F.lit(0.0)),
        "fraction_missing": F.coalesce(ratio(F.col("stem_missing"), F.col("truth_stems")), F.lit(0.0)),
        "fraction_unmatched": F.coalesce(ratio(F.col("unmatched_predicted"), F.col("predicted_stems")), F.lit(0.0)),
    })


def stem_greedy_match(candidates: DataFrame) -> DataFrame:
    """One-to-one matching in the order (overlap, smaller arm, union, outer pairs)."""
    order = [-F.col("pair_overlap"), -F.col("min_arm"), F.col("pair_union"),
             F.col("t_left_start"), F.col("t_right_end"), F.col("p_left_start"), F.col("p_right_end")]
    aliased = [c.alias(f"o{n}") for n, c in enumerate(order)]
    return mutual_best(candidates, TRUTH_STEM, PRED_STEM, aliased)


def fp_stem_attribution(status: DataFrame, predicted: DataFrame, states: DataFrame) -> DataFrame:
    """False pairs by the fate of the predicted stem they lie in."""
    chain_of = stem_pairs(predicted, RECORD).select(*RECORD, *PAIR, "left_start", "right_end")
    fate = states.where("role = 'prediction'").select(*RECORD, "left_start", "right_end", "state")
    rows = (
        status.where("status = 'FP'").join(chain_of, [*RECORD, *PAIR])
        .join(fate, [*RECORD, "left_start", "right_end"], "left")
    )
    state = F.coalesce(F.col("state"), F.lit("outside_stems"))
    return rows.groupBy("source").agg(
        F.count("*").alias("fp_total"),
        *[F.count_if(state == s).alias(f"fp_{n}") for s, n in (
            ("exact", "exact"), ("stem_truncation", "truncation"), ("stem_extension", "extension"),
            ("stem_shift", "shift"), ("complex_mismatch", "complex"), ("ambiguous", "ambiguous"),
            ("unmatched_predicted_stem", "unmatched"), ("outside_stems", "outside"))],
    )
