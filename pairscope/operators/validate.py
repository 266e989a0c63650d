"""Corpus-wide checks. Each returns a table of findings; nothing is repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.functions.ratios import ratio

# fixed values: allowed sequence symbols, score symmetry tolerance
SEQUENCE_ALPHABET = "ACGURYSWKMBDHVN"
SYMMETRY_TOLERANCE = 1e-7


def validate_pairs(pairs: DataFrame, keys: Sequence[str], allow_multiple_partners: bool = False) -> tuple[DataFrame, DataFrame]:
    """``pairs``: keys, ordinal, i, j, sequence_length -> (canonical pairs of clean structures, rejects).

    A structure is rejected with the code of its first offending pair in input order. Windows are keyed by
    pair and by endpoint, so a long structure is spread over many tasks.
    """
    keys = list(keys)
    i, j = F.col("i"), F.col("j")
    earlier_same = F.row_number().over(Window.partitionBy(*keys, "i", "j").orderBy("ordinal")) > 1
    code = (
        F.when(i == j, "self_pair").when(i > j, "reversed_pair")
        .when((i < 0) | (j >= F.col("sequence_length")), "out_of_range_pair").when(earlier_same, "duplicate_pair")
    )
    rows = pairs.withColumn("code", code)
    faults = rows.where("code IS NOT NULL").select(*keys, "ordinal", F.lit(0).alias("step"), "code")
    if not allow_multiple_partners:
        ends = rows.select(*keys, "ordinal", F.explode(F.array(
            F.struct(i.alias("e"), j.alias("p")), F.struct(j.alias("e"), i.alias("p")))).alias("x")).select(*keys, "ordinal", "x.*")
        previous = F.lag("p").over(Window.partitionBy(*keys, "e").orderBy("ordinal", "p"))
        clash = ends.withColumn("previous", previous).where("previous <> p")
        faults = faults.unionByName(clash.select(
            *keys, "ordinal", F.lit(1).alias("step"), F.lit("multiple_partners").alias("code")))
    rejects = faults.groupBy(*keys).agg(
        F.min_by("code", F.struct("ordinal", "step")).alias("code"), F.min("ordinal").alias("ordinal"))
    return rows.join(rejects.select(*keys), keys, "left_anti").select(*keys, "i", "j"), rejects


def partner_conflicts(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions with more than one distinct partner, with the sorted partners."""
    ends = pairs.select(*keys, F.explode(F.array(
        F.struct(F.col("i").alias("position"), F.col("j").alias("partner")),
        F.struct(F.col("j").alias("position"), F.col("i").alias("partner")))).alias("x")).select(*keys, "x.*")
    return ends.groupBy(*keys, "position").agg(F.array_sort(F.collect_set("partner")).alias("partners")).where(F.size("partners") > 1)


def sequence_violation(sequence: Column) -> Column:
    return (
        F.when(sequence.isNull() | (sequence == ""), "empty")
        .when((sequence != F.upper(sequence)) | sequence.rlike(r"\s"), "not_upper_or_whitespace")
        .when(sequence.rlike(f"[^{SEQUENCE_ALPHABET}]"), "illegal_symbol")
    )


def validate_sequences(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("code", sequence_violation(F.col("sequence"))).where("code IS NOT NULL")


def record_violations(version: str, dataset: str) -> Column:
    """Array of violation codes of one nested record (schema.RECORD), empty when it honours the contract."""
    checks = []
    for name in ("record_id", "dataset", "rna_id", "source", "sequence", "truth", "prediction", "provenance"):
        checks.append((F.col(name).isNull(), f"missing_{name}"))
    checks += [
        (~F.col("schema_version").eqNullSafe(F.lit(version)), "schema_version"),
        (F.col("dataset") != dataset, "dataset"),
        (sequence_violation(F.col("sequence")).isNotNull(), "sequence"),
        (~F.col("sequence_length").eqNullSafe(F.length("sequence")), "sequence_length"),
    ]
    for field in ("truth", "prediction"):
        checks += [
            (F.length(f"{field}.source_value") != F.length("sequence"), f"{field}_length"),
            (~F.col(f"{field}.pairs").eqNullSafe(F.array_sort(F.array_distinct(f"{field}.pairs"))), f"{field}_not_canonical"),
        ]
    checks += [
        (F.size("provenance") == 0, "provenance_empty"),
        (F.exists("provenance", lambda p: (F.coalesce(p["path"], F.lit("")) == "") | (F.coalesce(p["sha256"], F.lit("")) == "")),
         "provenance_incomplete"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for test, code in checks]))


def validate_record_contract(records: DataFrame, version: str, dataset: str) -> DataFrame:
    return records.withColumn("violations", record_violations(version, dataset)).where(F.size("violations") > 0)


def validate_panel(records: DataFrame, truth_key: str, sources: Sequence[str]) -> DataFrame:
    """Findings over the whole panel: duplicate ids, incomplete panels, disagreeing sequences or truths.

    ``truth_key`` is a hash column of the sorted true pairs, so truths compare without moving pair arrays.
    """
    ids = records.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("record_id").alias("key"), F.lit("duplicate_record_id").alias("finding"))
    one = records.groupBy("rna_id", "source").agg(
        F.count("*").alias("n"), F.min("sequence").alias("s0"), F.max("sequence").alias("s1"),
        F.min(truth_key).alias("t0"), F.max(truth_key).alias("t1"))
    rna = one.groupBy("rna_id").agg(
        F.count_if(F.col("source").isin(*sources)).alias("known"), F.count("*").alias("sources"), F.max("n").alias("n"),
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    findings = F.array_compact(F.array(
        F.when((F.col("known") != len(sources)) | (F.col("sources") != len(sources)) | (F.col("n") > 1), F.lit("panel_incomplete")),
        F.when(F.col("s0") != F.col("s1"), F.lit("sequence_disagrees")),
        F.when(F.col("t0") != F.col("t1"), F.lit("truth_disagrees")),
    ))
    return ids.unionByName(rna.select(F.col("rna_id").alias("key"), F.explode(findings).alias("finding")))


def pair_set_hash(pairs: DataFrame, keys: Sequence[str], name: str = "pairs_sha256") -> DataFrame:
    """SHA-256 of the sorted pair list per key."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j"))), lambda p: F.concat_ws("-", p["i"], p["j"])), ",")
    return pairs.groupBy(*keys).agg(F.sha2(text, 256).alias(name))


def normalize_scores(cells: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Zero the diagonal and nothing else; ``cells`` (keys, i, j, score, sequence_length), absent cells are 0.

    Returns (normalized cells of accepted matrices, one report row per matrix with a code and eleven statistics).
    """
    keys = list(keys)
    diagonal = F.col("i") == F.col("j")
    bad_value = F.col("score").isNull() | F.isnan("score") | F.col("score").isin(float("inf"), float("-inf"))
    after = F.when(diagonal, F.lit(0.0)).otherwise(F.col("score"))
    by_cell = cells.withColumn("after", after).groupBy(
        *keys, "sequence_length", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")
    ).agg(
        F.count("*").alias("n"), F.count_if(bad_value).alias("bad"),
        F.count_if((F.col("i") < 0) | (F.greatest("i", "j") >= F.col("sequence_length"))).alias("outside"),
        F.min("score").alias("lo"), F.max("score").alias("hi"),
        F.abs(F.sum(F.when(F.col("i") < F.col("j"), F.col("score")).when(F.col("i") > F.col("j"), -F.col("score")).otherwise(0.0))).alias("asym"),
        F.max(F.abs(F.when(diagonal, 0.0).otherwise(F.col("after") - F.col("score")))).alias("moved"),
    )
    on_diagonal = F.col("a") == F.col("b")
    L = F.col("sequence_length")
    stats = by_cell.groupBy(*keys, "sequence_length").agg(
        F.sum("bad").alias("bad"), F.sum("outside").alias("outside"), F.sum("n").alias("cells"),
        F.count_if(on_diagonal & (F.col("hi") != 0)).alias("diagonal_nonzero_before"),
        F.count_if(on_diagonal).alias("_dn"), F.min(F.when(on_diagonal, F.col("lo"))).alias("_dmin"),
        F.max(F.when(on_diagonal, F.col("hi"))).alias("_dmax"),
        F.max("asym").alias("max_asymmetry_before"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"),
        F.min(F.when(~on_diagonal, F.col("lo"))).alias("_lo2"), F.max(F.when(~on_diagonal, F.col("hi"))).alias("_hi2"),
        F.coalesce(F.max("moved"), F.lit(0.0)).alias("max_off_diagonal_change"),
    )
    zero_somewhere = F.col("cells") < L * L
    zero_on_diagonal = F.col("_dn") < L
    def low(c, implicit): return F.when(implicit, F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))).otherwise(F.col(c))
    def high(c, implicit): return F.when(implicit, F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))).otherwise(F.col(c))
    report = stats.withColumns({
        "diagonal_min_before": low("_dmin", zero_on_diagonal), "diagonal_max_before": high("_dmax", zero_on_diagonal),
        "min_score_before": low("_lo", zero_somewhere), "max_score_before": high("_hi", zero_somewhere),
        "diagonal_nonzero_after": F.lit(0), "max_asymmetry_after": F.col("max_asymmetry_before"),
        "min_score_after": low("_lo2", F.lit(True)), "max_score_after": high("_hi2", F.lit(True)),
    }).withColumn("code", F.when(F.col("outside") > 0, "shape").when(F.col("bad") > 0, "non_finite")
                  .when((F.col("min_score_before") < 0) | (F.col("max_score_before") > 1), "range")
                  .when(F.col("max_asymmetry_before") > SYMMETRY_TOLERANCE, "asymmetric"))
    accepted = cells.join(report.where("code IS NOT NULL").select(*keys), keys, "left_anti").withColumn("score", after)
    return accepted, report


def slug(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def record_id(*components: Column) -> Column:
    """Slugged components joined by ``__``; null when any slug is empty. ``record_ids`` reports those rows."""
    slugs = [slug(c) for c in components]
    usable = F.lit(True)
    for s in slugs:
        usable = usable & s.isNotNull() & (s != "")
    return F.when(usable, F.concat_ws("__", *slugs))


def record_ids(rows: DataFrame, *components: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a record_id, rejects with the code ``empty_component``)."""
    named = rows.withColumn("record_id", record_id(*components))
    return named.where("record_id IS NOT NULL"), named.where("record_id IS NULL").drop("record_id").withColumn("code", F.lit("empty_component"))


def warnings_summary(records: DataFrame) -> DataFrame:
    return records.select(F.explode("warnings").alias("w")).groupBy(F.col("w.code").alias("code")).agg(F.count("*").alias("n"))


def coverage_audit(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing, extra or duplicated; empty when the two key sets agree."""
    both = (
        expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("o"))
        .unionByName(observed.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("o")))
        .groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
    )
    findings = F.array_compact(F.array(
        F.when(F.col("o") == 0, F.lit("missing")), F.when(F.col("e") == 0, F.lit("extra")),
        F.when(F.col("o") > 1, F.lit("duplicate")), F.when(F.col("e") > 1, F.lit("duplicate_expected"))))
    return both.select(*keys, F.explode(findings).alias("finding"))


def validity_summary(records: DataFrame, rejects: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Valid, invalid and scored records by source, with the extremes of the score statistics."""
    joined = (
        records.select(key, "source")
        .join(rejects.select(key, F.lit(1).alias("_bad")).distinct(), key, "left")
        .join(reports.select(key, F.lit(1).alias("_scored"), "code", "max_asymmetry_before", "diagonal_nonzero_before",
                             "min_score_before", "max_score_before"), key, "left")
    )
    return joined.groupBy("source").agg(
        F.count("*").alias("records"), F.count_if(F.col("_bad").isNull()).alias("valid"), F.count("_bad").alias("invalid"),
        F.count("_scored").alias("with_scores"), F.count("code").alias("score_rejects"),
        F.max("max_asymmetry_before").alias("max_asymmetry"), F.sum("diagonal_nonzero_before").alias("diagonal_nonzero"),
        F.min("min_score_before").alias("min_score"), F.max("max_score_before").alias("max_score"))


def score_drift(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Largest absolute difference between two score tables, and keys present on one side only."""
    joined = left.select(*keys, F.col("score").alias("a")).join(right.select(*keys, F.col("score").alias("b")), list(keys), "full_outer")
    return joined.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_drift"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
        ratio(F.count_if(F.col("a") == F.col("b")), F.count("*")).alias("equal_fraction"))
