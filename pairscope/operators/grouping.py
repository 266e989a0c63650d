"""Sequence similarity, leakage-safe components and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pairscope.functions.graph import connected_components
from pairscope.session import cut_lineage

GRAM = 3


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """One row per distinct sequence; copies meet again through the sequence text."""
    return rows.groupBy("sequence").agg(F.count("*").alias("copies"), F.min("rna_id").alias("rna_id"))


def similar_sequences(rows: DataFrame, identity: float = 0.8) -> DataFrame:
    """Pairs of distinct sequences with ``1 - levenshtein / longer length >= identity`` (identity 0.8 or higher).

    This similarity is declared: an edit-distance identity, not an alignment score. Exact: a pair within k edits shares
    at least ``longer - 2 - 3k`` trigrams, so both prefixes of rarest trigrams must share one (prefix filter). Copies are
    collapsed first and hot trigrams fall outside the prefixes. Below six letters that bound is empty; there at most one
    edit is allowed, and two sequences within one edit share a form with one letter left out or none.
    """
    if identity < 0.8:
        raise ValueError("the trigram bound needs identity >= 0.8")
    base = distinct_sequences(rows).select("sequence", F.length("sequence").alias("n"))
    grams = base.where(F.col("n") >= GRAM).withColumn("p", F.explode(F.sequence(F.lit(1), F.col("n") - (GRAM - 1)))).select(
        "sequence", "n", F.substring(F.col("sequence"), F.col("p"), F.lit(GRAM)).alias("g"), "p")
    # repeated trigrams are numbered, so multisets become sets
    numbered = grams.withColumn("k", F.row_number().over(Window.partitionBy("sequence", "g").orderBy("p")))
    frequency = numbered.groupBy("g", "k").agg(F.count("*").alias("f"))
    rarest = Window.partitionBy("sequence").orderBy("f", "g", "k")  # one row's trigrams
    edits = 1 - identity
    overlap = F.ceil(F.round(F.col("n") * (1 - GRAM * edits), 9) - (GRAM - 1))
    prefix = F.col("n") - (GRAM - 1) - F.greatest(overlap, F.lit(1)) + 1
    tokens = numbered.join(frequency, ["g", "k"]).withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= prefix).select(
        "sequence", "n", "g", "k")
    a = tokens.select("g", "k", F.col("sequence").alias("a"), F.col("n").alias("na"))
    b = tokens.select("g", "k", F.col("sequence").alias("b"), F.col("n").alias("nb"))
    longer = F.greatest("na", "nb")
    close = a.join(b, ["g", "k"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= F.floor(F.round(longer * edits, 9))))
    pairs = close.select("a", "b", longer.alias("longer")).unionByName(_short_pairs(base)).distinct()
    limit = F.floor(F.round(F.col("longer") * edits, 9)).cast("int")
    # the distance itself is only needed up to the limit
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= limit).withColumn(
        "identity", 1 - F.col("distance") / F.col("longer")).select("a", "b", "identity")


def _short_pairs(base: DataFrame) -> DataFrame:
    """Candidate pairs of sequences of up to five letters within one edit."""
    left_out = F.transform(F.sequence(F.lit(1), F.col("n")), lambda p: F.concat(
        F.substring(F.col("sequence"), F.lit(1), p - 1), F.substring(F.col("sequence"), p + 1, F.col("n"))))
    forms = base.where(F.col("n").between(1, 5)).select("sequence", "n", F.explode(F.array_distinct(F.concat(F.array("sequence"), left_out))).alias("form"))
    other = forms.select(F.col("sequence").alias("b"), F.col("n").alias("m"), "form")
    return forms.withColumnRenamed("sequence", "a").join(other, "form").where("a < b").select("a", "b", F.greatest("n", "m").alias("longer"))


def leave_one_source_out(records: DataFrame, roles: DataFrame) -> DataFrame:
    """(held_out, rotation, rna_id, source, role): the held-out source is tested, the others train and validate.

    ``roles`` has rotation, rna_id, role of :func:`fold_roles`; a source never meets its own test sequences in training.
    """
    held = records.agg(F.collect_set("source").alias("s"))  # the names of the sources, one row
    rows = records.select("rna_id", "source").join(roles.select("rotation", "rna_id", "role"), "rna_id")
    crossed = rows.withColumn("held_out", F.explode(held.scalar()))
    own = F.col("source") == F.col("held_out")
    return crossed.where((own & (F.col("role") == "test")) | (~own & (F.col("role") != "test"))).select("held_out", "rotation", "rna_id", "source", "role")


def identity_components(rows: DataFrame, similar: DataFrame) -> DataFrame:
    """rna_id -> component (smallest sequence of the component); a copy shares its sequence's component."""
    found = connected_components(similar.select("a", "b")).select(F.col("node").alias("sequence"), "component")
    return rows.select("rna_id", "sequence").join(found, "sequence", "left").select(
        "rna_id", F.sha2(F.coalesce("component", "sequence"), 256).alias("component_id"))


def grouped_folds(components: DataFrame, folds: int = 5) -> DataFrame:
    """Whole components to folds, by size in serpentine order; ranks come from running totals over sizes."""
    from pairscope.functions.running import running_totals, value_buckets
    sizes = components.groupBy("component_id").agg(F.count("*").alias("size"))
    ranked = running_totals(
        value_buckets(sizes.withColumn("_neg", -F.col("size")), "_neg"), [], ["_neg", "component_id"], {"rank": F.lit(1)})
    turn = (F.col("rank") - 1) % (2 * folds)
    fold = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn)
    return components.join(ranked.select("component_id", "size", fold.cast("int").alias("fold")), "component_id")


def fold_roles(assignment: DataFrame, folds: int = 5) -> DataFrame:
    """(rotation, rna_id, role): test fold r, validation fold r+1, the rest train."""
    r = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("rotation")
    return assignment.select("rna_id", "fold", r).withColumn(
        "role", F.when(F.col("fold") == F.col("rotation"), "test")
        .when(F.col("fold") == (F.col("rotation") + 1) % folds, "validation").otherwise("train"))


#: Reference sequences of a block that new sequences are compared with.
BLOCK = 2048
LETTERS = "ACGU"


def _profile(rows: DataFrame, prefix: str) -> DataFrame:
    """Length and letter counts of each sequence, as columns that start with ``prefix``."""
    n = F.length("sequence")
    counts = [n - F.length(F.replace(F.col("sequence"), F.lit(c), F.lit(""))) for c in LETTERS]
    other = n - sum(counts, F.lit(0))
    return rows.select(F.col("sequence").alias(f"{prefix}_sequence"), n.alias(f"{prefix}_n"), F.array(*counts, other).alias(f"{prefix}_bag"),
                       *[c for c in rows.columns if c != "sequence"])


def best_of_all(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Columns sequence, identity, nearest: the most similar reference of each query sequence, smallest id on ties.

    The queries are a stated set and meet every reference, in blocks. Counting letters bounds the distance from below, so the
    distance itself is only taken where the bound could still beat the reference with the best bound.
    """
    blocks = F.greatest(F.ceil(refs.agg(F.count("*")).scalar() / BLOCK), F.lit(1)).cast("int")
    dealt = cut_lineage(_profile(refs, "r").withColumn("block", F.pmod(F.xxhash64("r_sequence"), blocks).cast("int")))
    numbers = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    asked = cut_lineage(_profile(queries.select("sequence").distinct(), "q"))
    both = asked.select("*", numbers).join(dealt, "block")
    extra = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.greatest(p - q, F.lit(0))), F.lit(0), lambda s, v: s + v)
    least = F.greatest(extra("q_bag", "r_bag"), extra("r_bag", "q_bag"))
    longer = F.greatest("q_n", "r_n")
    pairs = both.select("q_sequence", "r_sequence", "ref_id", longer.alias("longer"), F.when(longer == 0, 1.0).otherwise(1 - least / longer).alias("bound"))
    exact = F.when(F.col("longer") == 0, 1.0).otherwise(1 - F.levenshtein("q_sequence", "r_sequence") / F.col("longer"))
    first = pairs.groupBy("q_sequence").agg(F.max_by(F.struct("r_sequence", "longer"), F.struct("bound", "ref_id")).alias("f")).select("q_sequence", "f.*")
    reached = cut_lineage(first.select("q_sequence", exact.alias("reached")))
    open_pairs = pairs.join(reached, "q_sequence").where(F.col("bound") >= F.col("reached") - 1e-9)
    best = open_pairs.withColumn("identity", exact).groupBy("q_sequence").agg(
        F.max("identity").alias("identity"), F.min_by("ref_id", F.struct(-F.col("identity"), F.col("ref_id"))).alias("nearest"))
    return best.withColumnRenamed("q_sequence", "sequence")


def nearest_reference(fresh: DataFrame, reference: DataFrame, identity: float = 0.8) -> DataFrame:
    """For each new sequence the most similar reference sequence (smallest id on ties), and eligibility.

    The filter join of ``similar_sequences`` settles those at or above the identity; the others, and only they, are compared with
    all references. The identity is null only where there is no reference, or no sequence.
    """
    refs = reference.groupBy("sequence").agg(F.min("rna_id").alias("ref_id"))
    everything = fresh.select("rna_id", "sequence").unionByName(reference.select("rna_id", "sequence"))
    close = similar_sequences(everything, identity)
    both = close.select("a", "b", "identity").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "identity"))
    same = refs.select(F.col("sequence").alias("a"), F.col("sequence").alias("b"), F.lit(1.0).alias("identity"))
    hits = cut_lineage(both.unionByName(same).join(refs, F.col("b") == F.col("sequence")).groupBy("a").agg(
        F.max("identity").alias("identity"), F.min_by("ref_id", F.struct(-F.col("identity"), F.col("ref_id"))).alias("nearest"))
        .withColumnRenamed("a", "sequence"))
    rest = fresh.select("sequence").distinct().where(F.col("sequence").isNotNull()).join(hits, "sequence", "left_anti")
    found = hits.unionByName(best_of_all(rest, refs.where(F.col("sequence").isNotNull())))
    out = fresh.select("rna_id", "sequence").join(found, "sequence", "left")
    return out.withColumn("reason", F.when(F.col("sequence").rlike("[^ACGU]"), "alphabet").when(
        F.round("identity", 9) >= identity, "redundant").otherwise("eligible"))
