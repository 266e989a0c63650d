"""Raw-looking inputs derived from the tables, with faults at known ids, for the readers and checks.

Texts that several steps read are written once, as files would be, so their construction is not part of a reader's plan. The files of
matrices and dot plots are many times the size of the tables; their readers take one pass, and nothing writes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from pairscope.functions.shaping import computed_once
from pairscope.operators.ingest import render_brackets
from pairscope.operators.metrics import RECORD
from pairscope.plans.tables import Tables
from pairscope.session import cut_lineage
from pairscope.sources.derived import SOURCES


def d() -> Column:
    return F.col("rna_id").cast("bigint")


def scratch(t: Tables, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def at(modulus: int, remainder: int) -> Column:
    return d() % modulus == remainder


def _family() -> Column:
    return F.when((F.col("i") == 11) & (F.col("j") == 36), 2).otherwise(1)


def predicted_texts(t: Tables) -> DataFrame:
    """Bracket text per record: wrong length, lost opening, unclosed opening, illegal symbol at some ids."""
    text = render_brackets(
        t.predicted.withColumn("family", _family()), t.records.select(*RECORD, "sequence_length"), RECORD)
    # one projection per fault: each reads the text twice, so Spark keeps the steps apart
    for fault, value in (
        (at(17, 3), F.overlay("text", F.lit("."), 3, 1)),
        (at(19, 4), F.overlay("text", F.lit("("), F.col("sequence_length"), 1)),
        (at(23, 5), F.overlay("text", F.lit("*"), 1, 1)),
        (at(13, 0), F.concat("text", F.lit("."))),
    ):
        text = text.withColumn("text", F.when(fault, value).otherwise(F.col("text")))
    return cut_lineage(text)


def _truth_arrays(t: Tables) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.array("i", "j"))).alias("pairs")
    return t.rnas.select("rna_id", "sequence_length").join(t.truth.groupBy("rna_id").agg(pairs), "rna_id")


def truth_lists(t: Tables) -> DataFrame:
    L, first = F.col("sequence_length"), F.col("first")
    lists = _truth_arrays(t).withColumn("first", F.col("pairs")[0]).withColumn(
        "base", F.when(at(29, 0), 2).otherwise((d() % 2).cast("int")))
    head = F.when(at(41, 3), F.array(first[0], first[0])).when(at(31, 1), F.reverse(first)).otherwise(first)
    extra = [F.when(at(m, r), F.array(x)).otherwise(F.expr("cast(array() AS array<array<int>>)")) for m, r, x in (
        (37, 2, first), (43, 4, F.array(L, L + 1)), (47, 5, F.array(first[0], L - 1)))]
    lists = lists.withColumn("all", F.concat(F.array(head), F.slice("pairs", 2, F.greatest(F.size("pairs") - 1, F.lit(0))), *extra))
    return lists.select("rna_id", "sequence_length", F.col("base").alias("index_base"),
                        F.expr("transform(all, x -> transform(x, v -> v + base))").alias("pairs"))


def _matrix_rows(rnas: DataFrame, marks: DataFrame) -> DataFrame:
    """Dense 0/1 matrix per RNA from (rna_id, r, c, v) cells; only the marks are shuffled, the rest is filled in inside the row."""
    rows = marks.groupBy("rna_id", "r").agg(F.map_from_entries(F.collect_set(F.struct("c", "v"))).alias("cells"))
    marked = rows.groupBy("rna_id").agg(F.map_from_entries(F.collect_list(F.struct("r", "cells"))).alias("marked"))
    matrix = """transform(sequence(0, sequence_length - 1), r -> transform(array(marked[r]), cells -> CASE WHEN cells IS NULL
        THEN array_repeat(0, sequence_length) ELSE transform(sequence(0, sequence_length - 1), c -> coalesce(cells[c], 0)) END)[0])"""
    return computed_once(rnas.select("rna_id", "sequence_length").join(marked, "rna_id", "left"), "matrix", F.expr(matrix)).drop("marked")


def _marks(t: Tables) -> DataFrame:
    p = t.truth
    return p.select("rna_id", F.col("i").alias("r"), F.col("j").alias("c"), F.lit(1).alias("v")).unionByName(
        p.select("rna_id", F.col("j").alias("r"), F.col("i").alias("c"), F.lit(1).alias("v")))


def truth_matrices(t: Tables) -> DataFrame:
    def cell(condition: Column, r: Column, c: Column, value: int = 1) -> Column:
        return F.when(condition, F.array(F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), F.lit(value).alias("v"))))\
            .otherwise(F.expr("cast(array() AS array<struct<r: int, c: int, v: int>>)"))

    last = F.col("sequence_length") - 1
    extra = t.rnas.select("rna_id", F.explode(F.concat(
        cell(at(11, 1), F.lit(0), F.lit(0)), cell(at(13, 2), F.lit(0), last), cell(at(19, 3), F.lit(0), F.lit(1), 2),
        cell(at(7, 5), F.lit(2), last), cell(at(7, 5), last, F.lit(2)))).alias("x")).select("rna_id", "x.*")
    return cut_lineage(_matrix_rows(t.rnas, _marks(t).unionByName(extra)).withColumn(
        "matrix", F.when(at(23, 4), F.slice("matrix", 1, F.size("matrix") - 1)).otherwise(F.col("matrix"))))


def mixed_structures(t: Tables) -> DataFrame:
    """True structures in four formats by id, and one format nobody supports."""
    text = render_brackets(
        t.truth.withColumn("family", _family()), t.rnas.select("rna_id", "sequence_length"), ["rna_id"])
    # a matrix is many times its pairs, so only the RNAs that are written as one get it
    matrices = _matrix_rows(t.rnas.where(at(4, 3)), _marks(t).where(at(4, 3)))
    rows = (
        _truth_arrays(t).join(matrices.select("rna_id", "matrix"), "rna_id", "left")
        .join(text.select("rna_id", "text"), "rna_id")
    )
    one_based = F.to_json(F.transform("pairs", lambda p: F.transform(p, lambda v: v + 1)))
    kind = (
        F.when(at(29, 7), "stockholm").when(at(4, 0), "dot_bracket").when(at(4, 1), "extended_dot_bracket")
        .when(at(4, 2), "pair_list").otherwise("dense_matrix")
    )
    value = F.when(at(4, 2), one_based).when(at(4, 3), F.to_json("matrix")).otherwise(F.col("text"))
    return cut_lineage(rows.select(
        "rna_id", "sequence_length", kind.alias("source_format"), value.alias("source_value"), F.lit(1).alias("index_base")))


def pooled_predictions(t: Tables) -> DataFrame:
    """All sources of an RNA as one structure: shared pairs repeat and positions get several partners."""
    s = F.array_position(F.array(*[F.lit(x) for x in SOURCES]), F.col("source"))
    return t.predicted.join(t.rnas.select("rna_id", "sequence_length"), "rna_id").select(
        "rna_id", "sequence_length", (s * 100000 + F.col("i")).alias("ordinal"), "i", "j")


def faulty_sequences(t: Tables) -> DataFrame:
    s = F.col("sequence")
    return t.rnas.select("rna_id", F.when(at(17, 0), F.lit("")).when(at(7, 0), F.lower(s)).when(
        at(11, 0), F.concat(s, F.lit(" A"))).when(at(13, 0), F.concat(s, F.lit("X"))).otherwise(s).alias("sequence"))


def nested_records(t: Tables) -> DataFrame:
    """One nested record per (RNA, source) in the reader's schema, with contract faults by ``id % 10``."""
    pair = F.struct("i", "j")
    truth = t.truth.groupBy("rna_id").agg(F.array_sort(F.collect_list(pair)).alias("tp"))
    predicted = t.predicted.groupBy(*RECORD).agg(F.array_sort(F.collect_list(pair)).alias("pp"))
    rows = t.records.join(truth, "rna_id").join(predicted, RECORD, "left")
    empty = F.expr("cast(array() AS array<struct<i: int, j: int>>)")
    dots = F.repeat(F.lit("."), F.col("sequence_length"))

    def structure(label: str, pairs: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit("dot_bracket").alias("source_format"), dots.alias("source_value"),
                        pairs.alias("pairs"), F.lit(False).alias("allow_multiple_partners"))

    descriptor = F.struct(F.concat(F.lit("raw/"), F.col("record_id")).alias("path"),
                          F.when(at(10, 4), F.lit("")).otherwise(F.sha2("record_id", 256)).alias("sha256"))
    warning = F.struct(F.when(F.col("source") == SOURCES[1], "alias_applied").otherwise("settings_unknown").alias("code"),
                       F.lit("derived").alias("message"))
    pp = F.coalesce("pp", empty)
    return rows.select(
        F.when(at(10, 1), "0.9").otherwise("1.0").alias("schema_version"), "record_id", "dataset", "rna_id", "source",
        F.when(at(10, 6), F.lower("sequence")).otherwise(F.col("sequence")).alias("sequence"),
        F.when(at(10, 2), F.col("sequence_length") + 1).otherwise(F.col("sequence_length")).alias("sequence_length"),
        F.when(~at(10, 7), structure("truth", F.col("tp"))).alias("truth"),
        structure("prediction", F.when(at(10, 5), F.reverse(pp)).otherwise(pp)).alias("prediction"),
        F.when(d() % 3 == 0, F.array(warning)).otherwise(F.expr("array()")).alias("warnings"),
        F.when(at(10, 3), F.expr("array()")).otherwise(F.array(descriptor)).alias("provenance"),
        F.map_from_arrays(F.array(F.lit("threshold")), F.array(F.lit("0.5"))).alias("parameters"),
    )


def faulty_panel(t: Tables) -> DataFrame:
    copies = F.when(at(50, 3) & (F.col("source") == SOURCES[2]), F.array()).when(
        at(50, 4) & (F.col("source") == SOURCES[0]), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    second = F.col("source") == SOURCES[1]
    from pairscope.operators.validate import pair_set_hash
    rows = t.records.withColumn("_c", F.explode(copies)).join(pair_set_hash(t.truth, ["rna_id"], "truth_sha256"), "rna_id")
    return rows.withColumns({
        "sequence": F.when(at(50, 5) & second, F.reverse("sequence")).otherwise(F.col("sequence")),
        "truth_sha256": F.when(at(50, 6) & second, F.sha2("truth_sha256", 256)).otherwise(F.col("truth_sha256")),
    })


def score_cells(t: Tables) -> DataFrame:
    """Both triangles and some diagonal cells per record; asymmetric or out-of-range at some ids."""
    e = t.pair_events.join(t.rnas.select("rna_id", "sequence_length"), "rna_id")
    score = (1 - F.col("risk")) * F.when(at(15, 1), 2.0).otherwise(1.0)
    lower = score + F.when(at(10, 0), 0.01).otherwise(0.0)
    cells = F.explode(F.array(
        F.struct(F.col("i").alias("a"), F.col("j").alias("b"), score.alias("score")),
        F.struct(F.col("j").alias("a"), F.col("i").alias("b"), lower.alias("score")),
        F.struct(F.col("i").alias("a"), F.col("i").alias("b"), F.lit(0.5).alias("score"))))
    return e.select(*RECORD, "sequence_length", cells.alias("c")).select(
        *RECORD, "sequence_length", F.col("c.a").alias("i"), F.col("c.b").alias("j"), "c.score")


def structure_files(t: Tables) -> DataFrame:
    """Three-line files for even ids, two-line files for odd ones; layout and length faults at some ids."""
    text = render_brackets(t.truth.withColumn("family", _family()), t.rnas, ["rna_id"])
    body = F.when(d() % 2 == 0, F.concat_ws("\n", F.concat(F.lit(">"), F.col("rna_id")), "sequence", "text")).otherwise(
        F.concat_ws("\r\n", F.concat(F.lit("> "), F.col("rna_id")), "text", F.lit("")))
    body = F.when(at(26, 8), F.concat(body, F.lit(".")))\
        .when(at(31, 2), F.substring(body, F.lit(2), F.length(body))).otherwise(body)
    return text.select(F.concat(F.lit("structures/"), F.col("rna_id")).alias("path"), body.alias("value"))



def matrix_files(t: Tables) -> DataFrame:
    """Length line, then the matrix as text, then a trailing comment; cut or non-numeric at some ids."""
    rows = ("transform(sequence(0, sequence_length - 1), r -> array_join(cast(transform("
            "sequence(_d + 3 * r, _d + 3 * r + 5 * (sequence_length - 1), 5), x -> x % 1000) AS array<string>), ' '))")
    out = computed_once(computed_once(t.rnas.repartition("rna_id"), "_d", d()), "_rows", F.expr(rows))
    out = out.withColumn("_rows", F.when(at(21, 4), F.slice("_rows", 1, F.size("_rows") - 1)).when(
        at(25, 6), F.concat(F.array(F.lit("x y")), F.slice("_rows", 2, F.size("_rows")))).otherwise(F.col("_rows")))
    tail = F.when(at(21, 4), F.array()).otherwise(F.array(F.lit("# end")))
    return out.select(F.concat(F.lit("scores/"), F.col("rna_id")).alias("path"), "rna_id", F.concat_ws(
        "\n", F.concat(F.array(F.col("sequence_length").cast("string")), F.col("_rows"), tail)).alias("value"))


def dotplot_files(t: Tables) -> DataFrame:
    """Upper-triangle ``ubox`` lines between other lines; incomplete, repeated or invalid at some ids."""
    lines = ("flatten(transform(sequence(1, sequence_length - 1), r -> transform(sequence(r + 1, sequence_length), "
             "c -> concat_ws(' ', r, c, ((_d + 3 * r + 5 * c) % 100) / 100.0D, 'ubox'))))")
    out = computed_once(computed_once(t.rnas.repartition("rna_id"), "_d", d()), "_l", F.expr(lines))
    l = F.col("_l")
    out = out.withColumn("_l", F.when(at(20, 3), F.slice(l, 1, F.size(l) - 1)).when(
        at(20, 4), F.concat(l, F.array(l[0]))).when(at(20, 5), F.concat(F.array(F.lit("1 2 1.5 ubox")), F.slice(l, 2, F.size(l)))).otherwise(l))
    return out.select(
        F.concat(F.lit("plots/"), F.col("rna_id")).alias("path"), "sequence_length",
        F.concat(F.lit("%!header\n"), F.array_join("_l", "\n"), F.lit("\n1 2 0.9 lbox\nshowpage")).alias("value"))


ROLES = ("truth",) + SOURCES


def listing(t: Tables) -> DataFrame:
    roles = t.rnas.select("rna_id", F.posexplode(F.array(*[F.lit(r) for r in ROLES])).alias("r", "role"))
    copies = F.when((d() + F.col("r")) % 17 == 0, F.array()).when(
        (d() + F.col("r")) % 23 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    asset = F.when(at(10, 0) & (F.col("role") == SOURCES[1]), F.concat(F.lit("alias-"), F.col("rna_id"))).otherwise(F.col("rna_id"))
    return roles.withColumn("_c", F.explode(copies)).select(
        asset.alias("asset_id"), "role", F.when((d() + F.col("r")) % 19 == 0, 0).otherwise(100).alias("length"))


def aliases(t: Tables) -> DataFrame:
    return t.rnas.where(at(10, 0)).select("rna_id", F.lit(SOURCES[1]).alias("role"), F.concat(F.lit("alias-"), F.col("rna_id")).alias("asset_id"))
