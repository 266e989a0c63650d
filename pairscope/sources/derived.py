"""Structure tables that Spark derives from the ``documents`` table, one RNA per document.

Every rule is integer arithmetic on ``doc_id``, so the tables grow with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: source names, evidence grid, alphabet
SOURCES = ("src_a", "src_b", "src_c")
DENSITIES = (0, 1, 5, 10, 20, 50)
EVIDENCE_SEEDS = (101, 103, 107, 109, 113)
ALPHABET = "ACGU"


def rnas(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("d")).selectExpr(
        "d", "cast(d AS string) AS rna_id", "cast(2 + d % 3 AS int) AS nb",
        "cast(24 * (2 + d % 3) + 8 AS int) AS length",
    )


def _blocks(documents: DataFrame) -> DataFrame:
    return (
        rnas(documents).withColumn("b", F.explode(F.expr("sequence(0, nb - 1)")))
        .withColumn("g", F.expr("cast(2 + (d + b) % 4 AS int)"))
    )


def _pairs_column(*parts: Column) -> Column:
    return F.explode(F.concat(*parts)).alias("p")


def _when_pairs(condition: str, *pairs: str) -> Column:
    items = ", ".join(f"struct(cast({p.split('/')[0]} AS int) AS i, cast({p.split('/')[1]} AS int) AS j)" for p in pairs)
    return F.expr(f"CASE WHEN {condition} THEN array({items}) ELSE array() END")


def truth_pairs(documents: DataFrame) -> DataFrame:
    helix = F.expr(
        "transform(sequence(0, g - 1), k -> struct(cast(24*b + 2 + k AS int) AS i, cast(24*b + 21 - k AS int) AS j))"
    )
    return _blocks(documents).select(
        "rna_id",
        _pairs_column(
            helix,
            _when_pairs("(d + 2*b) % 5 = 0", "24*b + 9/24*b + 14"),
            _when_pairs("b = 0 AND d % 17 = 0", "11/36"),
        ),
    ).select("rna_id", "p.i", "p.j")


def predicted_pairs(documents: DataFrame) -> DataFrame:
    per_source = (
        _blocks(documents)
        .withColumn("s", F.explode(F.array(*[F.lit(s) for s in range(len(SOURCES))])))
        .withColumn("source", F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.col("s") + 1))
        .withColumn("v", F.expr("cast((7*d + 5*b + 3*s) % 11 AS int)"))
    )
    first = "CASE WHEN v IN (4, 10) THEN 1 ELSE 0 END"
    last = "CASE WHEN v IN (5, 10) THEN g ELSE g - 1 END"
    right = "CASE WHEN v = 6 THEN 22 ELSE 21 END"
    helix = F.expr(
        f"CASE WHEN v = 7 THEN array() ELSE transform(filter(sequence({first}, {last}), k -> NOT (v = 9 AND k = 2)), "
        f"k -> struct(cast(24*b + 2 + k AS int) AS i, cast(24*b + {right} - k AS int) AS j)) END"
    )
    return per_source.select(
        "rna_id", "source",
        _pairs_column(
            helix,
            _when_pairs("v = 8", "24*b + 9/24*b + 15", "24*b + 10/24*b + 14"),
            _when_pairs("v IN (0, 1, 2) AND (d + 2*b) % 5 = 0", "24*b + 9/24*b + 14"),
            _when_pairs("b = 0 AND s = 0 AND d % 34 = 0", "11/36"),
        ),
    ).select("rna_id", "source", "p.i", "p.j")


def records(documents: DataFrame) -> DataFrame:
    sequence = F.expr(
        f"array_join(transform(sequence(0, length - 1), p -> "
        f"substring('{ALPHABET}', cast((3*d + 7*p + p div 5) % 4 AS int) + 1, 1)), '')"
    )
    return (
        rnas(documents).withColumn("sequence", sequence)
        .withColumn("source", F.explode(F.array(*[F.lit(s) for s in SOURCES])))
        .select(
            F.concat_ws("__", F.lit("documents"), "rna_id", "source").alias("record_id"),
            F.lit("documents").alias("dataset"), "rna_id", "source", "sequence",
            F.col("length").alias("sequence_length"),
        )
    )


def folds(documents: DataFrame) -> DataFrame:
    return rnas(documents).select("rna_id", F.expr("cast(d % 5 AS int)").alias("fold"), "length")


def pair_events(documents: DataFrame) -> DataFrame:
    """Scored predicted pairs with labels; rotation 0 gives the partition names."""
    truth = truth_pairs(documents).withColumn("is_true", F.lit(1))
    counts = truth_pairs(documents).groupBy("rna_id").agg(F.count("*").alias("gt_pair_count"))
    labelled = (
        predicted_pairs(documents).join(truth, ["rna_id", "i", "j"], "left")
        .withColumn("label_delete", F.when(F.col("is_true").isNull(), 1).otherwise(0))
    )
    d = F.col("rna_id").cast("bigint")
    s = F.array_position(F.array(*[F.lit(x) for x in SOURCES]), F.col("source")) - 1
    mixed = (131 * d + 31 * F.col("i") + 17 * F.col("j") + 7 * s) % 700
    fold = (d % 5).cast("int")
    return labelled.join(counts, "rna_id").select(
        "rna_id", "source", fold.alias("fold"),
        F.when(fold == 0, "test").when(fold == 1, "validation").otherwise("train").alias("partition"),
        "i", "j", "label_delete",
        ((mixed + 300 * F.col("label_delete")) / F.lit(1000.0)).alias("risk"),
        "gt_pair_count",
    )
