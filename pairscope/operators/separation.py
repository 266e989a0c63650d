"""Sequence separation of pairs, fixed bins, exact quantiles and errors by bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairscope.functions.ratios import exact_prf, ratio
from pairscope.functions.running import grouped_quantiles
from pairscope.operators.metrics import PAIR, RECORD

# fixed values: relative-separation thresholds (a boundary value belongs to the lower bin),
# bin names, and the reported quantile levels
THRESHOLDS = (0.25, 0.5142857142857142, 0.8, 0.9333333333333333)
BINS = (
    "relative_q00_q25",
    "relative_q25_q50",
    "relative_q50_q75",
    "relative_q75_q90",
    "relative_q90_q100_long_range",
)
LEVELS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0)


def pair_separation(pairs: DataFrame, rnas: DataFrame) -> DataFrame:
    """Add ``separation`` and ``relative_separation``; both null when the length is 1 or less."""
    length = F.col("sequence_length")
    usable = (length > 1) & (F.col("i") >= 0) & (F.col("i") < F.col("j")) & (F.col("j") < length)
    return (
        pairs.join(rnas.select("rna_id", "sequence_length"), "rna_id")
        .withColumn("separation", F.when(usable, F.col("j") - F.col("i")))
        .withColumn("relative_separation", ratio(F.col("separation"), length - 1))
    )


def bin_of(relative: Column, thresholds=THRESHOLDS, names=BINS) -> Column:
    chain = F.when(relative.isNull(), F.lit(None))
    for threshold, name in zip(thresholds, names):
        chain = chain.when(relative <= threshold, F.lit(name))
    return chain.otherwise(F.lit(names[-1]))


def quantiles(separations: DataFrame) -> DataFrame:
    """Eight exact quantiles of raw and relative separation over true pairs."""
    long = separations.select(
        F.explode(F.array(
            F.struct(F.lit("raw").alias("variable"), F.col("separation").cast("double").alias("x")),
            F.struct(F.lit("relative").alias("variable"), F.col("relative_separation").alias("x")),
        )).alias("v")
    ).select("v.*")
    return grouped_quantiles(long, ["variable"], "x", LEVELS)


def candidate_binnings(separations: DataFrame) -> DataFrame:
    """True pairs and RNAs per bin when the bins are cut at data quantiles, for three definitions."""
    cuts = (
        quantiles(separations).where(F.col("level").isin(0.25, 0.5, 0.75, 0.9))
        .groupBy().agg(*[
            F.array_sort(F.collect_list(F.when(F.col("variable") == v, F.col("quantile")))).alias(v)
            for v in ("raw", "relative")
        ]).select(F.struct("raw", "relative").alias("cuts"))
    )
    rows = separations.withColumn("cuts", cuts.scalar())

    def index(variable: str, column: str) -> Column:
        return F.size(F.filter(F.col(f"cuts.{variable}"), lambda c: c < F.col(column)))

    hybrid = F.when(
        (F.col("relative_separation") > F.col("cuts.relative")[3]) & (F.col("separation") > F.col("cuts.raw")[1]), 1
    ).otherwise(0)
    tagged = rows.select("rna_id", F.explode(F.array(
        F.struct(F.lit("raw").alias("definition"), index("raw", "separation").alias("bin_index")),
        F.struct(F.lit("relative").alias("definition"), index("relative", "relative_separation").alias("bin_index")),
        F.struct(F.lit("hybrid_long_range").alias("definition"), hybrid.alias("bin_index")),
    )).alias("b")).select("rna_id", "b.*")
    # count per RNA first, so the distinct count is a plain sum of ones
    return (
        tagged.groupBy("definition", "bin_index", "rna_id").agg(F.count("*").alias("n"))
        .groupBy("definition", "bin_index").agg(F.sum("n").alias("pair_count"), F.count("*").alias("rna_count"))
    )


def pair_inventory(status: DataFrame, rnas: DataFrame) -> DataFrame:
    """Both roles in one long table: true pairs are TP/FN, predicted pairs TP/FP."""
    with_bins = pair_separation(status, rnas).withColumn("bin", bin_of(F.col("relative_separation")))
    roles = F.when(F.col("status") == "TP", F.array(F.lit("truth"), F.lit("prediction"))).when(
        F.col("status") == "FN", F.array(F.lit("truth"))).otherwise(F.array(F.lit("prediction")))
    return with_bins.withColumn("role", F.explode(roles)).select(
        *RECORD, *PAIR, "role", "status", "separation", "relative_separation", "bin")


def _every_bin(sources: DataFrame) -> DataFrame:
    return sources.select("source").distinct().withColumn("bin", F.explode(F.array(*[F.lit(b) for b in BINS])))


def _shares(rows: DataFrame, by_source: dict[str, str]) -> DataFrame:
    """Share of a count within its source; the per-source totals are a tiny second aggregate."""
    totals = rows.groupBy("source").agg(*[F.sum(c).alias(f"_t_{c}") for c in by_source.values()])
    out = rows.join(totals, "source")
    for name, column in by_source.items():
        out = out.withColumn(name, F.coalesce(ratio(F.col(column), F.col(f"_t_{column}")), F.lit(0.0)))
    return out.drop(*[f"_t_{c}" for c in by_source.values()])


def errors_by_separation(status: DataFrame, rnas: DataFrame, records: DataFrame) -> DataFrame:
    counts = (
        pair_separation(status, rnas).withColumn("bin", bin_of(F.col("relative_separation")))
        .groupBy("source", "bin").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("TP", "FP", "FN")])
    )
    full = _every_bin(records).join(counts, ["source", "bin"], "left").fillna(0, ["tp", "fp", "fn"])
    p, r, f = exact_prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return _shares(full.withColumns({"precision": p, "recall": r, "f1": f}), {"fp_share": "fp", "fn_share": "fn"})


def wrong_partner_by_separation(false_pairs: DataFrame, rnas: DataFrame, records: DataFrame) -> DataFrame:
    counts = (
        pair_separation(false_pairs, rnas).withColumn("bin", bin_of(F.col("relative_separation")))
        .groupBy("source", "bin").agg(
            F.count("*").alias("fp"), F.count_if(F.col("degree") > 0).alias("wrong_partner"),
            F.count_if(F.col("degree") == 0).alias("pure_fp"))
    )
    full = _every_bin(records).join(counts, ["source", "bin"], "left").fillna(0, ["fp", "wrong_partner", "pure_fp"])
    full = full.withColumn("wrong_share_in_bin", F.coalesce(ratio(F.col("wrong_partner"), F.col("fp")), F.lit(0.0)))
    return _shares(full, {"wrong_share_of_source": "wrong_partner", "pure_share_of_source": "pure_fp"})


def stem_separation_profile(stem_states: DataFrame, rnas: DataFrame) -> DataFrame:
    """Spread of the per-stem median separation by source, state and role.

    Separations inside a stem step by two, so the median is the mean of the outer and inner one.
    """
    outer = F.col("right_end") - F.col("left_start")
    inner = F.col("right_start") - F.col("left_end")
    median = (outer + inner) / 2
    rows = stem_states.join(rnas.select("rna_id", "sequence_length"), "rna_id").select(
        "source", "state", "role", "n_pairs", median.alias("raw"),
        ratio(median, F.col("sequence_length") - 1).alias("relative"),
    )
    stats = []
    for c in ("raw", "relative"):
        stats += [F.avg(c).alias(f"mean_{c}"), F.percentile(c, 0.5).alias(f"median_{c}"),
                  F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return rows.groupBy("source", "state", "role").agg(
        F.count("*").alias("stem_count"), F.sum("n_pairs").alias("stem_pair_count"), *stats)
