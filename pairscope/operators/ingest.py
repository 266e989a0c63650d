"""Structure text of any format to pairs, for a whole corpus at once.

Every function returns (pairs, rejects): canonical pairs of the accepted structures, and one
(keys..., code) row per rejected structure. Nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.functions.shaping import computed_once
from pairscope.operators.validate import validate_pairs

# fixed values: bracket families, an opening symbol and its closing symbol at the same place
OPENING = "([{<ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLOSING = ")]}>abcdefghijklmnopqrstuvwxyz"
FORMATS = ("dot_bracket", "extended_dot_bracket", "pair_list", "dense_matrix")


def _accept(parsed: DataFrame, early: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Drop early rejects, run the pair checks, and drop what those reject."""
    pairs = parsed.join(early.select(*keys), keys, "left_anti")
    valid, late = validate_pairs(pairs, keys)
    return valid, early.select(*keys, "code").unionByName(late.select(*keys, "code"))


def pairs_from_brackets(texts: DataFrame, keys: list[str], families: int | Column = len(OPENING)) -> tuple[DataFrame, DataFrame]:
    """``texts``: keys, text, sequence_length. Families match on their own, so crossing pairs survive.

    The depth of a symbol is a running count inside (structure, family); a closing symbol pairs with the
    symbol before it at the same depth. One structure is one text value, so a window holds one row's characters.
    """
    families = F.lit(families) if isinstance(families, int) else families
    bad_length = F.col("sequence_length").isNotNull() & (F.length("text") != F.col("sequence_length"))
    sized = texts.withColumn("_bad_length", bad_length).withColumn("_families", families)
    symbols = (
        sized.where(~F.col("_bad_length"))
        .select(*keys, "_families", F.length("text").alias("length"), F.posexplode(F.split("text", "")).alias("pos", "c"))
        .where("c <> '.' AND c <> ''")
        .withColumns({"_o": F.instr(F.lit(OPENING), F.col("c")), "_c": F.instr(F.lit(CLOSING), F.col("c"))})
        .withColumn("family", F.greatest("_o", "_c"))
        .withColumn("step", F.when((F.col("family") == 0) | (F.col("family") > F.col("_families")), 0)
                    .when(F.col("_o") > 0, 1).otherwise(-1))
    )
    by_family = Window.partitionBy(*keys, "family").orderBy("pos")
    deep = symbols.withColumn("depth", F.sum("step").over(by_family.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy(*keys, "family", "level").orderBy("pos")
    matched = (
        deep.where("step <> 0")
        .withColumn("level", F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1))
        .withColumns({"before": F.lag("pos").over(level), "before_step": F.lag("step").over(level)})
    )
    pairs = matched.where("step = -1 AND before_step = 1").select(
        *keys, "length", F.col("before").alias("i"), F.col("pos").alias("j"))
    # the first illegal or unmatched closing symbol decides; an unclosed opening symbol only if neither occurs
    fault = F.when(F.col("step") == 0, "illegal_structure_character").when(
        (F.col("step") == -1) & (F.col("depth") < 0), "unmatched_bracket")
    per_family = deep.withColumn("at", F.when(fault.isNotNull(), F.struct(F.col("pos"), fault.alias("code")))).groupBy(*keys, "family").agg(
        F.min("at").alias("at"), F.sum("step").alias("open"))
    early = per_family.groupBy(*keys).agg(
        F.min("at").alias("at"), F.max("open").alias("open")
    ).select(*keys, F.coalesce("at.code", F.when(F.col("open") > 0, "unmatched_bracket")).alias("code")).where("code IS NOT NULL")
    early = early.unionByName(sized.where("_bad_length").select(*keys, F.lit("length_mismatch").alias("code")))
    return _accept(
        pairs.select(*keys, F.col("length").alias("sequence_length"), F.col("j").alias("ordinal"), "i", "j"), early, keys)


def pairs_from_list(lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``lists``: keys, sequence_length, index_base, pairs ARRAY<ARRAY<INT>>."""
    code = (
        F.when(~F.coalesce(F.col("index_base").isin(0, 1), F.lit(False)), "invalid_index_base")
        .when(F.col("pairs").isNull() | F.exists("pairs", lambda p: (F.size(p) != 2) | F.exists(p, F.isnull)), "invalid_pair")
        .when(F.col("sequence_length").isNull(), "missing_sequence_length")
    )
    tagged = lists.withColumn("code", code)
    exploded = tagged.where("code IS NULL").select(
        *keys, "sequence_length", "index_base", F.posexplode("pairs").alias("ordinal", "p")
    ).select(*keys, "sequence_length", "ordinal", (F.col("p")[0] - F.col("index_base")).alias("i"),
             (F.col("p")[1] - F.col("index_base")).alias("j"))
    return _accept(exploded, tagged.where("code IS NOT NULL"), keys)


def pairs_from_matrix(matrices: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``matrices``: keys, sequence_length, matrix ARRAY<ARRAY<INT>>; binary, symmetric, zero diagonal.

    Shape and values are checked on the arrays, so only the set cells are exploded and shuffled.
    """
    # parsed and judged once a matrix, whatever reads it later
    matrices = computed_once(matrices.withColumnRenamed("matrix", "_matrix"), "matrix", F.col("_matrix")).drop("_matrix")
    size = F.size("matrix")
    values = F.array_distinct(F.flatten("matrix"))
    code = (
        F.when(F.col("matrix").isNull() | F.exists("matrix", lambda r: r.isNull() | (F.size(r) != size)), "invalid_matrix_shape")
        .when(F.col("sequence_length").isNotNull() & (size != F.col("sequence_length")), "length_mismatch")
        .when(F.exists(values, lambda v: v.isNull() | ~v.isin(0, 1)), "invalid_matrix_value")
    )
    tagged = computed_once(matrices, "code", code)
    cells = (
        tagged.where("code IS NULL").select(*keys, size.alias("sequence_length"), F.posexplode("matrix").alias("r", "row"))
        .select(*keys, "sequence_length", "r", F.posexplode("row").alias("c", "v")).where("v = 1")
        .groupBy(*keys, "sequence_length", F.least("r", "c").alias("i"), F.greatest("r", "c").alias("j"))
        .agg(F.count("*").alias("n"))
    )
    # the first offending row decides between the diagonal and an asymmetric entry, the diagonal first
    fault = F.when(F.col("i") == F.col("j"), "self_pair").when(F.col("n") == 1, "asymmetric_matrix")
    early = cells.withColumn("f", fault).where("f IS NOT NULL").groupBy(*keys).agg(
        F.min_by("f", F.struct("i", "j")).alias("code"))
    early = early.unionByName(tagged.where("code IS NOT NULL").select(*keys, "code"))
    return _accept(cells.select(*keys, "sequence_length", F.col("i").alias("ordinal"), "i", "j"), early, keys)


def ingest_by_format(structures: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A mixed corpus (keys, source_format, source_value, sequence_length, index_base) in one pass."""
    kind = F.col("source_format")
    brackets = structures.where(kind.isin("dot_bracket", "extended_dot_bracket")).select(
        *keys, F.col("source_value").alias("text"), "sequence_length",
        F.when(kind == "dot_bracket", 1).otherwise(len(OPENING)).alias("_families"))
    array = F.from_json("source_value", "ARRAY<ARRAY<INT>>")
    parts = [
        pairs_from_brackets(brackets, keys, F.col("_families")),
        pairs_from_list(structures.where(kind == "pair_list").select(
            *keys, "sequence_length", "index_base", array.alias("pairs")), keys),
        pairs_from_matrix(structures.where(kind == "dense_matrix").select(
            *keys, "sequence_length", array.alias("matrix")), keys),
    ]
    unknown = structures.where(kind.isNull() | ~kind.isin(*FORMATS)).select(*keys, F.lit("unsupported_format").alias("code"))
    valid, rejects = parts[0][0].select(*keys, "i", "j"), parts[0][1].unionByName(unknown)
    for v, r in parts[1:]:
        valid, rejects = valid.unionByName(v.select(*keys, "i", "j")), rejects.unionByName(r)
    return valid, rejects


def render_brackets(pairs: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Bracket text per structure; ``family`` (1-based) picks the symbols. Structures without pairs are all dots."""
    marks = pairs.groupBy(*keys).agg(F.map_from_entries(F.flatten(F.collect_list(F.array(
        F.struct(F.col("i").alias("p"), F.substring(F.lit(OPENING), F.col("family"), F.lit(1)).alias("c")),
        F.struct(F.col("j").alias("p"), F.substring(F.lit(CLOSING), F.col("family"), F.lit(1)).alias("c")),
    )))).alias("marks"))
    text = F.expr("array_join(transform(sequence(0, sequence_length - 1), p -> coalesce(marks[cast(p AS int)], '.')), '')")
    return lengths.join(marks, keys, "left").withColumn("text", text).drop("marks")
