"""Queries on reading, decoding and validation."""

from pyspark.sql import functions as F

from pairscope.operators import ingest, validate
from pairscope.operators.metrics import RECORD
from pairscope.plans import inputs
from pairscope.plans.catalog import query
from pairscope.sources import readers, writers
from pairscope.sources.derived import SOURCES


def accepted_and_rejected(valid, rejects, keys):
    """One row per pair or reject, so both halves are compared."""
    return valid.select(*keys, "i", "j", F.lit("ok").alias("code")).unionByName(
        rejects.select(*keys, "code"), allowMissingColumns=True)


@query("v1_pairs_from_brackets", "rna_id:s source:s i:i j:i code:s")
def _(t):
    return accepted_and_rejected(*ingest.pairs_from_brackets(inputs.predicted_texts(t), RECORD), RECORD)


@query("v2_pairs_from_list", "rna_id:s i:i j:i code:s")
def _(t):
    return accepted_and_rejected(*ingest.pairs_from_list(inputs.truth_lists(t), ["rna_id"]), ["rna_id"])


@query("v3_pairs_from_matrix", "rna_id:s i:i j:i code:s")
def _(t):
    return accepted_and_rejected(*ingest.pairs_from_matrix(inputs.truth_matrices(t), ["rna_id"]), ["rna_id"])


@query("v4_ingest_by_format", "rna_id:s i:i j:i code:s")
def _(t):
    return accepted_and_rejected(*ingest.ingest_by_format(inputs.mixed_structures(t), ["rna_id"]), ["rna_id"])


@query("v5_validate_pairs", "rna_id:s i:i j:i code:s")
def _(t):
    return accepted_and_rejected(*validate.validate_pairs(inputs.pooled_predictions(t), ["rna_id"]), ["rna_id"])


@query("v6_partner_conflicts", "rna_id:s position:i partners:s")
def _(t):
    out = validate.partner_conflicts(t.predicted.select("rna_id", "i", "j"), ["rna_id"])
    return out.withColumn("partners", F.array_join("partners", ","))


@query("v7_validate_sequences", "rna_id:s code:s")
def _(t):
    return validate.validate_sequences(inputs.faulty_sequences(t))


@query("v8_validate_record_contract", "record_id:s violations:s")
def _(t):
    out = validate.validate_record_contract(inputs.nested_records(t), "1.0", "documents")
    return out.withColumn("violations", F.array_join("violations", ","))


@query("v9_validate_panel", "key:s finding:s")
def _(t):
    return validate.validate_panel(inputs.faulty_panel(t), "truth_sha256", SOURCES)


SCORE_REPORT = ("rna_id:s source:s code:s diagonal_nonzero_before:i diagonal_min_before:d diagonal_max_before:d "
                "max_asymmetry_before:d min_score_before:d max_score_before:d diagonal_nonzero_after:i max_asymmetry_after:d "
                "min_score_after:d max_score_after:d max_off_diagonal_change:d")


@query("v10_normalize_scores", SCORE_REPORT)
def _(t):
    return validate.normalize_scores(inputs.score_cells(t), RECORD)[1]


@query("v10_normalized_cells", "rna_id:s source:s cells:i total:d diagonal_total:d")
def _(t):
    cells, _ = validate.normalize_scores(inputs.score_cells(t), RECORD)
    return cells.groupBy(*RECORD).agg(
        F.count("*").alias("cells"), F.sum("score").alias("total"),
        F.sum(F.when(F.col("i") == F.col("j"), F.col("score")).otherwise(0.0)).alias("diagonal_total"))


@query("v11_record_id", "doc_id:i record_id:s code:s")
def _(t):
    # a text of punctuation alone has no slug
    rows = t.documents.select("doc_id", "lang", "source", F.when(F.col("doc_id") % 50 == 7, F.lit("?!")).otherwise(F.col("text")).alias("text"))
    named, rejects = validate.record_ids(rows, F.lit("Docs v1"), F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.col("text"))
    return named.unionByName(rejects, allowMissingColumns=True)


@query("v12_warnings_summary", "code:s n:i")
def _(t):
    return validate.warnings_summary(inputs.nested_records(t))


@query("v13_coverage_join_audit", "doc_id:i finding:s")
def _(t):
    orders = t.raw("orders").select(F.col("o_custkey").alias("doc_id"))
    return validate.coverage_audit(t.documents, orders, ["doc_id"])


@query("v14_validity_summary",
       "source:s records:i valid:i invalid:i with_scores:i score_rejects:i max_asymmetry:d diagonal_nonzero:i min_score:d max_score:d")
def _(t):
    key = F.concat_ws("__", F.lit("documents"), "rna_id", "source")
    _, rejects = ingest.pairs_from_brackets(inputs.predicted_texts(t), RECORD)
    _, reports = validate.normalize_scores(inputs.score_cells(t), RECORD)
    return validate.validity_summary(
        t.records, rejects.withColumn("record_id", key), reports.withColumn("record_id", key), "record_id")


@query("v15_score_drift", "rna_id:s n:i max_drift:d unmatched:i equal_fraction:d")
def _(t):
    scored = t.pair_events.withColumn("score", 1 - F.col("risk"))
    return validate.score_drift(
        scored.where(F.col("source") == SOURCES[0]), scored.where(F.col("source") == SOURCES[1]), ["rna_id", "i", "j"], ["rna_id"])


@query("s1_read_records", "kind:s source:s n:i pairs:i parameters:s")
def _(t):
    path = inputs.scratch(t, "records")
    nested = inputs.nested_records(t)
    writers.write_table(nested, path, "jsonl")
    nested.where(inputs.at(20, 0)).select(F.concat(F.lit('{"record_id": "cut-'), "record_id", F.lit('", "sequence": "AC')).alias("value")) \
        .write.mode("append").text(path)
    records, rejects = readers.read_records(t.spark, path)
    good = records.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.size("prediction.pairs")).alias("pairs"), F.max(F.col("parameters")["threshold"]).alias("parameters"))
    bad = rejects.groupBy().agg(F.count("*").alias("n"))
    return good.withColumn("kind", F.lit("record")).unionByName(bad.withColumn("kind", F.lit("reject")), allowMissingColumns=True)


@query("s2_ingest_structures", "path:s rna_id:s length:i has_sequence:i code:s")
def _(t):
    records, rejects = readers.ingest_structures(inputs.structure_files(t))
    return records.select("path", "rna_id", F.length("text").alias("length"), F.col("sequence").isNotNull().cast("int").alias("has_sequence"),
                          F.lit("ok").alias("code")).unionByName(rejects, allowMissingColumns=True)


def totals(cells, **sums):
    """One row per file of (path, code, score and whatever ``sums`` reads): counts and sums of a good file, the code of a rejected one."""
    good = F.col("code").isNull()
    out = cells.where("code IS NOT NULL OR score IS NOT NULL").groupBy("path", "code").agg(
        F.count("score").alias("cells"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return out.withColumns({"cells": F.when(good, F.col("cells")), "code": F.coalesce("code", F.lit("ok"))})


@query("s3_ingest_scores", "path:s cells:i total:i weighted:i code:s")
def _(t):
    # files are made and read in one pass; rejected ones keep a row without cells
    files = readers.score_matrices(inputs.matrix_files(t))
    rows = files.select("path", "code", F.posexplode_outer(F.when(F.col("code").isNull(), F.col("matrix"))).alias("i", "row"))
    cells = rows.select("path", "code", "i", F.posexplode_outer("row").alias("j", "score"))
    return totals(cells, total=F.col("score"), weighted=F.col("score") * (F.col("i") + 2 * F.col("j")))


@query("s4_ingest_dotplot", "path:s cells:i total:d code:s")
def _(t):
    files = readers.dotplots(inputs.dotplot_files(t))
    return totals(files.select("path", "code", F.inline_outer(F.when(F.col("code").isNull(), F.col("cells")))), total=F.col("score"))


@query("s5_write_tables", "kind:s n:i risk:d")
def _(t):
    events, out = t.pair_events.select("rna_id", "source", "i", "j", "risk", "partition"), None
    for kind in ("parquet", "csv", "csv.gz", "json"):
        path = inputs.scratch(t, "sink")
        writers.write_table(events, path, kind, ["partition"] if kind == "parquet" else [])
        read = t.spark.read.schema("rna_id STRING, source STRING, i INT, j INT, risk DOUBLE")
        if kind == "parquet":
            back = read.parquet(path)
        elif kind == "json":
            back = read.json(path)
        else:
            # CSV columns are positional; the writer keeps the table's order
            back = t.spark.read.schema(events.schema).option("header", "true").csv(path)
        part = back.groupBy().agg(F.count("*").alias("n"), F.sum("risk").alias("risk")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("s6_read_partition", "rna_id:s source:s i:i j:i risk:d")
def _(t):
    path = inputs.scratch(t, "partitioned")
    writers.write_table(t.pair_events, path, "parquet", ["partition", "fold"])
    return readers.read_partition(t.spark, path, ["rna_id", "source", "i", "j", "risk"], "`partition` = 'validation' AND fold = 1 AND risk >= 0.5")


@query("s7_asset_manifest", "rna_id:s role:s code:s")
def _(t):
    _, rejects = ingest.pairs_from_brackets(inputs.predicted_texts(t), RECORD)
    failures = rejects.select("rna_id", F.col("source").alias("role"), "code")
    return readers.asset_manifest(t.rnas, inputs.ROLES, inputs.listing(t), inputs.aliases(t), failures)


@query("s7_unique_sequence_match", "rna_id:s match_id:s")
def _(t):
    library = t.documents.select(F.col("doc_id").cast("string").alias("rna_id"), F.col("text").alias("sequence"))
    return readers.unique_sequence_match(library, library)
