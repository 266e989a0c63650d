"""Readers and text decoders; all schemas are explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairscope import schema
from pairscope.functions.shaping import computed_once


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a JSON-lines stream; malformed lines are kept with their text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).select("value", F.from_json("value", schema.RECORD, options).alias("r"))
    whole = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    return (
        lines.where(whole).select("r.*").drop("_corrupt"),
        lines.where(~whole).select(F.col("value").alias("_corrupt")),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, value)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", F.sha2("content", 256).alias("sha256"))
    )


def _lines(column: str = "value"):
    return F.filter(F.transform(F.split(column, r"\r?\n"), lambda line: F.trim(line)), lambda line: line != "")


def ingest_structures(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of ``>name / sequence / structure`` or ``>name / structure`` lines -> (records, rejects)."""
    parsed = computed_once(files, "_l", _lines()).withColumn("_n", F.size("_l"))
    named = F.col("_l")[0].startswith(">")
    rows = parsed.withColumns({
        "rna_id": F.when(named, F.trim(F.substring(F.col("_l")[0], F.lit(2), F.length(F.col("_l")[0])))),
        "sequence": F.when(F.col("_n") == 3, F.get("_l", F.lit(1))),
        "text": F.get("_l", F.col("_n") - 1),
        "code": F.when(~F.col("_n").isin(2, 3) | ~named, "layout"),
    }).withColumn("code", F.coalesce("code", F.when(
        F.col("sequence").isNotNull() & (F.length("sequence") != F.length("text")), "length_mismatch")))
    return (
        rows.where("code IS NULL").select("path", "rna_id", "sequence", "text", F.sha2("value", 256).alias("sha256")),
        rows.where("code IS NOT NULL").select("path", "code"),
    )


def score_matrices(files: DataFrame) -> DataFrame:
    """A length line and that many rows of numbers -> (path, matrix ARRAY<ARRAY<DOUBLE>>, code), one row per file.

    Lines after the matrix are allowed. A file is one value and is judged inside its row, so no cell is shuffled; the code of a good file is null.
    """
    lines = computed_once(files.select("path", "value"), "_l", _lines()).withColumn("n", F.expr("try_cast(get(_l, 0) AS int)"))
    matrix = F.expr(r"CASE WHEN n > 0 THEN transform(slice(_l, 2, n), line -> try_cast(split(line, '\\s+') AS array<double>)) END")
    rows = computed_once(lines, "matrix", matrix)
    layout = F.col("matrix").isNull() | (F.size("matrix") != F.col("n"))
    # array_contains is true where a row holds NaN, and null where it holds none but a word that is no number
    ragged = F.expr("exists(matrix, row -> size(row) <> n OR coalesce(array_contains(row, double('NaN')), true))")
    return computed_once(rows, "code", F.when(layout, "layout").when(ragged, "matrix")).select("path", "matrix", "code")


def ingest_scores(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, i, j, score) of the good files of ``score_matrices``, and (path, code) of short or ragged ones."""
    rows = score_matrices(files)
    cells = rows.where("code IS NULL").select("path", F.posexplode("matrix").alias("i", "row")).select(
        "path", "i", F.posexplode("row").alias("j", "score"))
    return cells, rows.where("code IS NOT NULL").select("path", "code")


def dotplots(files: DataFrame) -> DataFrame:
    """``i j sqrt(p) ubox`` lines -> (path, cells ARRAY<STRUCT<i, j, score>>, code), one row per file; ``files`` also carries sequence_length.

    A file must give every cell of the upper triangle exactly once with p in [0, 1]. It is judged inside its row, as in ``score_matrices``.
    """
    # one match a line, space never runs into the next one; all three groups take part in every match
    space = r"[ \\t\\x0B\\f\\r]"
    line = rf"(?md)^{space}*+(\\d++){space}++(\\d++){space}++(\\S++){space}++ubox{space}*+[\\x{{85}}\\x{{2028}}\\x{{2029}}]?$"
    rows = files.select("path", "sequence_length", "value")
    for k, (name, kind) in enumerate((("_i", "int"), ("_j", "int"), ("_p", "double"))):
        rows = computed_once(rows, name, F.expr(f"try_cast(regexp_extract_all(coalesce(value, ''), '{line}', {k + 1}) AS array<{kind}>)"))
    rows = computed_once(rows, "cells", F.expr("transform(_i, (i, k) -> struct(i - 1 AS i, _j[k] - 1 AS j, _p[k] * _p[k] AS score))"))
    bad = F.expr("exists(cells, c -> NOT coalesce(c.i >= 0 AND c.i < c.j AND c.j < sequence_length AND c.score BETWEEN 0 AND 1, false))")
    distinct = F.expr("size(array_distinct(transform(cells, c -> shiftleft(cast(c.i AS bigint), 32) + c.j)))")
    want = F.col("sequence_length") * (F.col("sequence_length") - 1) / 2
    code = F.when(bad, "invalid_record").when(distinct < F.size("cells"), "duplicate").when(F.size("cells") != want, "incomplete")
    return computed_once(rows, "code", code).select("path", "cells", "code")


def ingest_dotplot(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, i, j, score) of the good files of ``dotplots``, and (path, code) of the others."""
    rows = dotplots(files)
    return rows.where("code IS NULL").select("path", F.inline("cells")), rows.where("code IS NOT NULL").select("path", "code")


def read_partition(spark: SparkSession, path: str, columns: Sequence[str], condition: str) -> DataFrame:
    """Columns and rows of a partitioned table; Catalyst prunes folders, row groups and columns."""
    return spark.read.parquet(path).where(condition).select(*columns)


def asset_manifest(expected: DataFrame, roles: Sequence[str], listing: DataFrame, aliases: DataFrame, parse_failures: DataFrame) -> DataFrame:
    """Expected ids x roles against a listing (asset_id, role, length) -> one row per gap or failure.

    ``aliases`` (rna_id, role, asset_id) renames single assets; ``parse_failures`` has (rna_id, role, code).
    """
    wanted = expected.select("rna_id", F.explode(F.array(*[F.lit(r) for r in roles])).alias("role"))
    named = wanted.join(aliases, ["rna_id", "role"], "left").withColumn("asset_id", F.coalesce("asset_id", "rna_id"))
    found = named.join(listing.groupBy("asset_id", "role").agg(
        F.count("*").alias("files"), F.max("length").alias("length")), ["asset_id", "role"], "left")
    code = (
        F.when(F.col("files").isNull(), "missing").when(F.col("files") > 1, "ambiguous").when(F.col("length") == 0, "empty")
    )
    return found.withColumn("code", code).where("code IS NOT NULL").select("rna_id", "role", "code").unionByName(
        parse_failures.select("rna_id", "role", "code"))


def unique_sequence_match(wanted: DataFrame, library: DataFrame) -> DataFrame:
    """Ids of ``wanted`` whose sequence text occurs exactly once in ``library``."""
    single = library.groupBy("sequence").agg(F.count("*").alias("n"), F.min("rna_id").alias("match_id")).where("n = 1")
    return wanted.join(single, "sequence", "left").select("rna_id", "match_id")


__all__ = ["read_records", "read_texts", "read_files", "ingest_structures", "score_matrices", "ingest_scores", "dotplots", "ingest_dotplot",
           "read_partition", "asset_manifest", "unique_sequence_match"]
