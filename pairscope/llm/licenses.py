"""License scans by diagonal voting.

Templates are cut into word 3-grams. All rolling 3-grams of a text are joined by hash to template positions and
compared word by word; a match votes for its diagonal, the text position less the template position. A phrase is
found where one diagonal holds all its grams. A longer template may have words inserted or left out, which moves the
diagonal: neighbouring diagonals are merged and the span is verified by coverage and length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pairscope.functions.shaping import computed_once
from pairscope.session import cut_lineage

GRAM = 3
#: Characters between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals that lie this close belong to one span.
SLACK = 6
COVERAGE = 0.8
LENGTH = 1.5


@dataclass(frozen=True)
class Template:
    """Lower-case words separated by spaces, three at least. ``exact``: all words in a row; ``base``: of the contract."""

    label: str
    text: str
    exact: bool = True
    base: bool = False


# fixed values: phrases and published license texts
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("cc-by-sa", "cc by sa"),
    Template(
        "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
        "whom the software is furnished to do so", exact=False),
    Template(
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met", exact=False),
    Template(
        "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation", exact=False),
)


def tokens(text: Column) -> Column:
    """Words after lower-casing A-Z. The Kelvin sign is no A-Z, though Unicode lower-cases it to k."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _gram_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """tid, tpos, gram, hash: one row per template position, as many as the templates have words."""
    rows = []
    for tid, template in enumerate(templates):
        split = template.text.split()
        if len(split) < GRAM:
            raise ValueError(f"a template has {GRAM} words at least")
        rows += [F.struct(F.lit(tid).alias("tid"), F.lit(k).alias("tpos"), *[F.lit(w).alias(f"w{j}") for j, w in enumerate(split[k:k + GRAM])])
                 for k in range(len(split) - GRAM + 1)]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    return table.withColumn("hash", F.xxhash64(*[f"w{j}" for j in range(GRAM)]))


def _template_table(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(tid).alias("tid"), F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact"), F.lit(t.base).alias("base"),
                 F.lit(len(t.text.split()) - GRAM + 1).alias("grams")) for tid, t in enumerate(templates)])))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES,
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): documents has rid, <id_col>, n_words for every row; spans has rid, label, base, first, last, coverage.

    ``rid`` tells rows apart that repeat an identifier. ``first`` and ``last`` are the span's first and last word, from 0.
    """
    spark = docs.sparkSession
    thin = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    split = computed_once(thin, "w", tokens(F.col("text"))).select("rid", "id", "w", F.size("w").alias("n_words"))
    hashes = F.when(F.col("n_words") >= GRAM, F.transform(
        F.sequence(F.lit(0), F.col("n_words") - GRAM), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(GRAM)])))
    # place 0 stands for the document itself, so that one without any match keeps a row
    places = F.concat(F.array(F.lit(None).cast("bigint")), F.coalesce(hashes, F.array().cast("array<bigint>")))
    rolled = split.select("rid", "id", "n_words", "w", F.posexplode(places).alias("p", "h"))
    grams = F.broadcast(_gram_table(spark, templates))
    at = F.col("p") - 1
    same = F.lit(True)
    for j in range(GRAM):
        same = same & (F.get("w", at + j) == F.col(f"w{j}"))
    voted = rolled.join(grams, F.col("h") == F.col("hash"), "left").where((F.col("p") == 0) | same)
    rows = cut_lineage(voted.select("rid", "id", F.col("n_words").cast("bigint").alias("n_words"), "p", at.alias("at"), "tid", "tpos"))
    documents = rows.where("p = 0").select("rid", F.col("id").alias(id_col), "n_words")

    diagonals = (
        rows.where("p > 0").withColumn("d", F.col("at") - F.col("tpos")).groupBy("rid", "tid", "d")
        .agg(F.collect_set("tpos").alias("places"), F.min("at").alias("a"), F.max("at").alias("b"))
        .join(F.broadcast(_template_table(spark, templates)), "tid")
    )
    exact = diagonals.where(F.col("exact") & (F.size("places") == F.col("grams"))).select(
        "rid", "label", "base", F.col("a").alias("first"), (F.col("b") + GRAM - 1).alias("last"), F.lit(1.0).alias("coverage"))
    order = Window.partitionBy("rid", "tid").orderBy("d")
    apart = F.coalesce((F.col("d") - F.lag("d").over(order) > SLACK).cast("int"), F.lit(0))
    merged = (
        diagonals.where(~F.col("exact")).withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
        .groupBy("rid", "tid", "label", "base", "grams", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("a").alias("first"), (F.max("b") + GRAM - 1).alias("last"))
        .withColumn("coverage", F.size("places") / F.col("grams"))
        .where((F.col("coverage") >= COVERAGE) & (F.col("last") - F.col("first") + 1 <= LENGTH * (F.col("grams") + GRAM - 1)))
    )
    return documents, exact.unionByName(merged.select(*exact.columns))


def license_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES,
) -> DataFrame:
    """One row per input row: <id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base place, null without one. Labels are
    distinct, sorted and comma-joined, empty without any. ``score`` is the best coverage of a span, 0 without one.
    Null and empty texts have no words; repeated rows are repeated; an empty table gives none.
    """
    documents, spans = scan(docs, id_col, text_col, templates)

    def joined(column: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(column)), ",")

    found = spans.groupBy("rid").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"))
    return documents.join(found, "rid", "left").select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
