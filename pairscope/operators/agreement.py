"""Agreement between prediction sources, and features of a predicted pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.functions.ratios import ratio
from pairscope.operators.metrics import PAIR, RECORD
from pairscope.operators.stems import stem_pairs

# fixed values: feature vocabularies in encoding order (the inward list has no GG)
BASES = ("A", "C", "G", "U", "N/OTHER")
PAIR_TYPES = ("AA", "AC", "AG", "AU", "CA", "CC", "CG", "CU", "GA", "GC", "GG", "GU", "UA", "UC", "UG", "UU", "OTHER")
INWARD_TYPES = ("NONE",) + tuple(p for p in PAIR_TYPES if p != "GG")
CATEGORIES = {
    "base_i": BASES,
    "base_j": BASES,
    "pair_type": PAIR_TYPES,
    "outward_pair_type": ("NONE",) + PAIR_TYPES,
    "inward_pair_type": INWARD_TYPES,
}
NUMERIC = (
    "sequence_length", "raw_separation", "relative_separation", "singleton_flag", "strict_stem_length", "stem_pair_position",
    "normalized_stem_position", "outer_boundary_flag", "inner_boundary_flag", "outward_neighbor_exists", "inward_neighbor_exists",
)
CANONICAL = ("AU", "UA", "GC", "CG", "GU", "UG")


def source_bit(sources: Sequence[str]) -> Column:
    """One bit per source."""
    bit = F.lit(0)
    for n, s in enumerate(sources):
        bit = F.when(F.col("source") == s, F.lit(1 << n)).otherwise(bit)
    return bit


def support(predicted: DataFrame, sources: int = 3) -> DataFrame:
    """Add how many other sources predict the same pair, and as a risk how many of the others do not."""
    others = F.count("*").over(Window.partitionBy("rna_id", *PAIR)) - 1
    return predicted.withColumn("support", others.cast("int")).withColumn("support_risk", sources - 1 - F.col("support"))


def agreement_features(predicted: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Support, endpoint conflicts, neighbour support and stem support of every predicted pair.

    Which sources hold a pair is one bit mask per (RNA, i, j); every feature is a mask operation or a count.
    """
    own = source_bit(sources)
    masks = predicted.groupBy("rna_id", *PAIR).agg(F.bit_or(own).alias("mask"))
    occupied = (
        predicted.select("rna_id", F.explode(F.array("i", "j")).alias("e")).groupBy("rna_id", "e").agg(F.count("*").alias("held"))
    )

    def shifted(name: str, step: int) -> DataFrame:
        return masks.select("rna_id", (F.col("i") - step).alias("i"), (F.col("j") + step).alias("j"), F.col("mask").alias(name))

    rows = (
        stem_pairs(predicted, RECORD).withColumn("own", own).join(masks, ["rna_id", *PAIR])
        .join(shifted("inward_mask", 1), ["rna_id", *PAIR], "left").join(shifted("outward_mask", -1), ["rna_id", *PAIR], "left")
        .join(occupied.select("rna_id", F.col("e").alias("i"), F.col("held").alias("held_i")), ["rna_id", "i"])
        .join(occupied.select("rna_id", F.col("e").alias("j"), F.col("held").alias("held_j")), ["rna_id", "j"])
    )

    def others(mask: str) -> Column:
        return F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(F.bitwise_not(F.col("own")))

    stem = Window.partitionBy(*RECORD, "left_start", "right_end")
    in_stem = F.col("n_pairs") >= 2
    exact, mask = F.bit_count(others("mask")), F.col("mask")
    out = rows.withColumns({
        "support": exact,
        **{f"support_by_{s}": F.when(F.col("source") == s, 0).otherwise(F.sign(mask.bitwiseAND(F.lit(1 << n))).cast("int"))
           for n, s in enumerate(sources)},
        "any_support": (exact > 0).cast("int"), "all_agree": (exact == len(sources) - 1).cast("int"),
        # a source agrees at one endpoint exactly when it has the pair
        "agree_i": exact, "agree_j": exact,
        "conflict_i": F.col("held_i") - F.bit_count(mask), "conflict_j": F.col("held_j") - F.bit_count(mask),
        "inward_support": F.bit_count(others("inward_mask")), "outward_support": F.bit_count(others("outward_mask")),
        "stem_full_support": F.when(in_stem, (F.bit_and(others("mask")).over(stem) != 0).cast("int")).otherwise(0),
        "stem_fraction": F.when(in_stem, F.avg((others("mask") != 0).cast("int")).over(stem)).otherwise(0.0),
    })
    return out.withColumn("any_conflict", (F.col("conflict_i") + F.col("conflict_j") > 0).cast("int"))


def support_enrichment(events: DataFrame) -> DataFrame:
    """False share by support level, per source and pooled, against the base rate."""
    counts = events.groupingSets(
        [[F.col("source"), F.col("support")], [F.col("support")]], "source", "support"
    ).agg(F.coalesce(F.col("source"), F.lit("ALL")).alias("stratum"), F.count("*").alias("n"), F.sum("label_delete").alias("deletes"))
    base = counts.groupBy("stratum").agg(F.sum("n").alias("_n"), F.sum("deletes").alias("_d"))
    rows = counts.join(base, "stratum").withColumns({
        "delete_share": ratio(F.col("deletes"), F.col("n")), "base_rate": ratio(F.col("_d"), F.col("_n"))})
    w = Window.partitionBy("stratum").orderBy("support")  # three rows per stratum
    falls = F.coalesce(F.col("delete_share") <= F.lag("delete_share").over(w), F.lit(True))
    return rows.withColumn("enrichment", ratio(F.col("delete_share"), F.col("base_rate"))).withColumn("_falls", falls).withColumn(
        "monotonic", F.min(F.col("_falls").cast("int")).over(Window.partitionBy("stratum")))


def condition_potential(features: DataFrame) -> DataFrame:
    """Keep and delete counts under seven observable predicates, by source and over all (source ALL).

    ``features`` has support, any_conflict, n_pairs, label_delete.
    """
    none, one, two = [F.col("support") == n for n in range(3)]
    # fixed values: names of the published conditions
    predicates = {
        "support_other_count_0": none, "support_other_count_1": one, "support_other_count_2": two,
        "no_exact_support_plus_partner_conflict": none & (F.col("any_conflict") == 1),
        "no_exact_support_plus_singleton": none & (F.col("n_pairs") == 1),
        "exact_support_by_one_other_model": one, "exact_support_by_both_other_models": two,
    }
    everywhere = features.withColumn("source", F.explode(F.array(F.col("source"), F.lit("ALL"))))
    return long_counts(everywhere, predicates, "condition")


def long_counts(rows: DataFrame, predicates: dict[str, Column], name: str) -> DataFrame:
    tagged = rows.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))))
    return tagged.groupBy("source", name).agg(
        F.count("*").alias("n"), F.sum("label_delete").alias("deletes"), F.count_if(F.col("label_delete") == 0).alias("keeps"))


def pair_class(pair_type: Column) -> Column:
    return F.when(pair_type.isin("AU", "UA", "GC", "CG"), "watson_crick").when(pair_type.isin("GU", "UG"), "wobble").otherwise("other")


def _type_at(i: Column, j: Column) -> Column:
    text = F.concat(F.substring(F.col("sequence"), i + 1, F.lit(1)), F.substring(F.col("sequence"), j + 1, F.lit(1)))
    return F.when(text.rlike("^[ACGU]{2}$"), text).otherwise("OTHER")


def topology_features(predicted: DataFrame, rnas: DataFrame) -> DataFrame:
    """Observable features of a pair. A stacked neighbour exists exactly when the pair is not at that end of its chain."""
    def base(c: str) -> Column:
        letter = F.substring(F.col("sequence"), F.col(c) + 1, F.lit(1))
        return F.when(letter.isin("A", "C", "G", "U"), letter).otherwise("N/OTHER")

    i, j, n, pos = F.col("i"), F.col("j"), F.col("n_pairs"), F.col("pos")
    stem = n >= 2
    outward, inward = pos > 0, pos < n - 1
    return stem_pairs(predicted, RECORD).join(rnas.select("rna_id", "sequence", "sequence_length"), "rna_id").withColumns({
        "base_i": base("i"), "base_j": base("j"), "pair_type": _type_at(i, j),
        "raw_separation": j - i, "relative_separation": F.coalesce(ratio(j - i, F.col("sequence_length") - 1), F.lit(0.0)),
        "singleton_flag": (~stem).cast("int"), "strict_stem_length": F.when(stem, n).otherwise(0),
        "stem_pair_position": F.when(stem, pos).otherwise(0),
        "normalized_stem_position": F.when(stem, ratio(pos, n - 1)).otherwise(0.0),
        "outer_boundary_flag": (stem & ~outward).cast("int"), "inner_boundary_flag": (stem & ~inward).cast("int"),
        "outward_neighbor_exists": outward.cast("int"), "inward_neighbor_exists": inward.cast("int"),
        "outward_pair_type": F.when(outward, _type_at(i - 1, j + 1)).otherwise("NONE"),
        "inward_pair_type": F.when(inward, _type_at(i + 1, j - 1)).otherwise("NONE"),
    })


def encoded_columns() -> dict[str, Column]:
    """The 78 named candidate columns: numeric features, then one-hot with an UNKNOWN column per field."""
    columns = {n: F.col(n).cast("float") for n in NUMERIC}
    for field, vocabulary in CATEGORIES.items():
        for value in vocabulary:
            columns[f"{field}={value}"] = (F.col(field) == value).cast("float")
        columns[f"{field}=UNKNOWN"] = (~F.col(field).isin(*vocabulary)).cast("float")
    return columns


def encode_candidate(features: DataFrame) -> DataFrame:
    """80 float columns: the 78 plus half the support count and the pair probability."""
    columns = encoded_columns()
    columns["support_div_2"] = (F.col("support") / 2).cast("float")
    columns["pair_probability"] = F.col("pair_probability").cast("float")
    return features.select(*RECORD, *PAIR, *[c.alias(n) for n, c in columns.items()])


def label_balance(events: DataFrame) -> DataFrame:
    """KEEP and DELETE counts by source and over all; RNAs that hold a DELETE."""
    per_rna = events.groupBy("source", "rna_id").agg(F.count("*").alias("n"), F.sum("label_delete").alias("d"))
    per_source = per_rna.groupBy("source").agg(
        F.sum("n").alias("n"), F.sum("d").alias("deletes"), F.count("*").alias("rnas"), F.count_if(F.col("d") > 0).alias("rnas_with_delete"))
    total = per_rna.groupBy("rna_id").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).groupBy().agg(
        F.sum("n").alias("n"), F.sum("d").alias("deletes"), F.count("*").alias("rnas"), F.count_if(F.col("d") > 0).alias("rnas_with_delete"))
    return per_source.unionByName(total.withColumn("source", F.lit("ALL"))).withColumns({
        "keeps": F.col("n") - F.col("deletes"), "delete_fraction": ratio(F.col("deletes"), F.col("n"))})


# fixed values: the published dimensions and their bins
def audit_dimensions() -> dict[str, Column]:
    """Dimensions of the feature audit."""
    stem, n, pos = F.col("strict_stem_length") >= 2, F.col("strict_stem_length"), stem_place()
    return {
        "structural_unit": F.when(stem, "strict_stem").otherwise("singleton"),
        "stem_length": F.when(~stem, "not_in_stem").when(n == 2, "length_2").when(n == 3, "length_3").otherwise("length_4_plus"),
        "stem_position": F.when(pos == "stem_interior", "interior").otherwise(pos),
        "pair_class": pair_class(F.col("pair_type")),
        "pair_type": F.col("pair_type"),
    }


def stem_place() -> Column:
    return (
        F.when(F.col("singleton_flag") == 1, "singleton").when(F.col("outer_boundary_flag") == 1, "outer_boundary")
        .when(F.col("inner_boundary_flag") == 1, "inner_boundary").otherwise("stem_interior"))


def harm_dimensions() -> dict[str, Column]:
    """Dimensions of the harm profile."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    n, raw, relative = F.col("strict_stem_length"), F.col("raw_separation"), F.col("relative_separation")
    return {
        "singleton": yes(F.col("singleton_flag") == 1),
        "strict_stem": yes(n >= 2),
        "two_pair_stem": yes(n == 2),
        "outer_boundary": yes(F.col("outer_boundary_flag") == 1),
        "inner_boundary": yes(F.col("inner_boundary_flag") == 1),
        "topology_position": stem_place(),
        "pair_type": F.col("pair_type"),
        "raw_separation_bin": F.when(raw < 10, "lt10").when(raw < 25, "10_24").when(raw < 50, "25_49").otherwise("ge50"),
        "relative_separation_bin": F.when(relative <= 0.25, "q0_0.25").when(relative <= 0.5, "q0.25_0.50").when(relative <= 0.75, "q0.50_0.75").otherwise("q0.75_1.00"),
        "stem_length": F.when(n == 0, "singleton").when(n < 5, n.cast("string")).otherwise("5_plus"),
    }


def diagnostic_dimensions() -> dict[str, Column]:
    """Dimensions of the classification diagnostics."""
    raw = F.col("raw_separation")
    edge = (F.col("outer_boundary_flag") == 1) | (F.col("inner_boundary_flag") == 1)
    return {
        "singleton": F.col("singleton_flag").cast("string"),
        "stem_length": F.col("strict_stem_length").cast("string"),
        "boundary": F.when(edge, "boundary").otherwise("interior"),
        "pair_type": F.col("pair_type"),
        "separation": F.when(raw < 10, "short").when(raw < 25, "medium").otherwise("long"),
    }


def by_dimension(rows: DataFrame, dimensions: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Measures for each value of each dimension, from one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in dimensions.items()]))
    return rows.withColumn("_d", pairs).groupBy(F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(
        *[m.alias(n) for n, m in measures.items()])


def feature_balance(features: DataFrame) -> DataFrame:
    return by_dimension(features, audit_dimensions(), {
        "n": F.count("*"), "deletes": F.sum("label_delete"), "delete_fraction": F.avg("label_delete")})


def harm_profile(selected: DataFrame) -> DataFrame:
    """Selected deletions by dimension, with the share of all harm and benefit inside the dimension."""
    rows = by_dimension(selected, harm_dimensions(), {
        "deletions": F.count("*"), "harmful": F.count_if(F.col("label_delete") == 0), "beneficial": F.sum("label_delete")})
    w = Window.partitionBy("dimension")  # a handful of values
    return rows.withColumns({
        "harm_share": ratio(F.col("harmful"), F.sum("harmful").over(w)),
        "benefit_share": ratio(F.col("beneficial"), F.sum("beneficial").over(w))})


def standardize_fit(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population std (floored at 1e-8) of each column."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"mean_{c}"), F.greatest(F.stddev_pop(c), F.lit(1e-8)).alias(f"std_{c}")]
    return rows.agg(*stats)


def standardize_apply(rows: DataFrame, fitted: DataFrame, columns: Sequence[str], usable: Column | None = None) -> DataFrame:
    """Centre and scale with the fitted row (a scalar subquery); rows that are not usable become exact zeros."""
    packed = fitted.select(F.struct("*").alias("s"))
    out = rows.withColumn("_s", packed.scalar())
    for c in columns:
        scaled = (F.col(c) - F.col(f"_s.mean_{c}")) / F.col(f"_s.std_{c}")
        out = out.withColumn(c, scaled if usable is None else F.when(usable, scaled).otherwise(0.0))
    return out.drop("_s")
