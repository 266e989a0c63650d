"""Wrong-partner relations between false and missing pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairscope.operators.metrics import PAIR, RECORD


def endpoints(pairs: DataFrame, keys: list[str], position: str = "e", partner: str = "partner") -> DataFrame:
    """Two rows per pair: an endpoint and what it pairs with."""
    return pairs.withColumn(
        "_e", F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
                                F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    ).select(*keys, *PAIR, F.col("_e.a").alias(position), F.col("_e.b").alias(partner))


def _linked(rows: DataFrame, other: DataFrame, other_keys: list[str]) -> DataFrame:
    """For each pair of ``rows``: endpoints that ``other`` pairs differently, and the pairs doing so."""
    mine = endpoints(rows, RECORD)
    theirs = endpoints(other, other_keys, partner="other_partner").drop(*PAIR)
    joined = mine.join(theirs, other_keys + ["e"], "left")
    conflict = F.col("other_partner").isNotNull() & (F.col("other_partner") != F.col("partner"))
    link = F.struct(F.least("e", "other_partner").alias("i"), F.greatest("e", "other_partner").alias("j"))
    return joined.groupBy(*RECORD, *PAIR).agg(
        F.count_if(conflict).alias("degree"),
        F.array_sort(F.collect_list(F.when(conflict, F.col("e")))).alias("conflict_endpoints"),
        F.array_sort(F.collect_set(F.when(conflict, link))).alias("links"),
    )


def wrong_partner_events(status: DataFrame, truth: DataFrame) -> DataFrame:
    """False pairs with one or two endpoints that truth pairs elsewhere, with the missing pairs they displace."""
    return false_pair_annotations(status, truth).where("degree > 0")


def false_pair_annotations(status: DataFrame, truth: DataFrame) -> DataFrame:
    return _linked(status.where("status = 'FP'"), truth, ["rna_id"])


def missing_pair_annotations(status: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every missing pair with degree 0-2 and the false pairs that hold its endpoints."""
    return _linked(status.where("status = 'FN'"), predicted, RECORD)


def pair_error_table(status: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row per missing and per false pair."""
    false = false_pair_annotations(status, truth).withColumn("error_type", F.lit("false_positive_pair"))
    missing = missing_pair_annotations(status, predicted).withColumn("error_type", F.lit("missing_pair"))
    return false.unionByName(missing).withColumn("wrong_partner", (F.col("degree") > 0).cast("int"))


def pair_error_summary(errors: DataFrame, records: DataFrame) -> DataFrame:
    false = F.col("error_type") == "false_positive_pair"
    missing = F.col("error_type") == "missing_pair"
    linked = F.col("wrong_partner") == 1
    per_record = errors.unionByName(
        records.select(*RECORD), allowMissingColumns=True
    ).groupBy(*RECORD).agg(
        F.count_if(missing).alias("missing_pairs"), F.count_if(false).alias("false_pairs"),
        F.count_if(false & linked).alias("wrong_partner_pairs"),
        F.count_if(false & ~linked).alias("pure_false_pairs"),
        F.count_if(missing & linked).alias("linked_missing_pairs"),
        F.count_if(missing & ~linked).alias("pure_missing_pairs"),
        F.count_if(false & (F.col("degree") == 1)).alias("degree1"),
        F.count_if(false & (F.col("degree") == 2)).alias("degree2"),
    )
    names = ["missing_pairs", "false_pairs", "wrong_partner_pairs", "pure_false_pairs",
             "linked_missing_pairs", "pure_missing_pairs", "degree1", "degree2"]
    return per_record.groupBy("source").agg(
        F.count("*").alias("n_samples"), *[F.sum(n).alias(n) for n in names],
        F.count_if(F.col("wrong_partner_pairs") > 0).alias("samples_with_wrong_partner"),
    )
