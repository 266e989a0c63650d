"""Small hand-checked cases, and brute force for the iterative and running programs."""

import itertools
import random

from pyspark.sql import functions as F

from pairscope.functions.graph import connected_components
from pairscope.functions.running import grouped_quantiles, running_totals, value_buckets
from pairscope.operators import errors, evidence, ingest, metrics, reliability, stems, thresholds, validate


def pairs(spark, rows, schema="rna_id string, source string, i int, j int"):
    return spark.createDataFrame(rows, schema)


def records(spark, *names):
    return spark.createDataFrame([(n, "s") for n in names], "rna_id string, source string")


def truth(spark, rows):
    return spark.createDataFrame([("x", i, j) for i, j in rows], "rna_id string, i int, j int")


def predicted(spark, rows):
    return pairs(spark, [("x", "s", i, j) for i, j in rows])


def test_metrics_and_empty_convention(spark):
    t = spark.createDataFrame([("a", 0, 9), ("a", 1, 8), ("a", 2, 7), ("c", 0, 5)], "rna_id string, i int, j int")
    p = pairs(spark, [("a", "s", 0, 9), ("a", "s", 2, 7), ("d", "s", 1, 6)])
    got = {r.rna_id: r for r in metrics.pair_metrics(records(spark, "a", "b", "c", "d"), t, p).collect()}
    assert (got["a"].tp, got["a"].fn, got["a"].f1) == (2, 1, 0.8)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (1.0, 1.0, 1.0)
    assert got["c"].f1 == 0.0 and got["d"].f1 == 0.0


def test_wrong_partner_degrees(spark):
    for true_pairs, degree, links in (([(0, 9)], 1, 1), ([(0, 9), (1, 8)], 2, 2)):
        t, p = truth(spark, true_pairs), predicted(spark, [(0, 8)])
        event = errors.wrong_partner_events(metrics.pair_status(records(spark, "x"), t, p), t).first()
        assert event.degree == degree and len(event.links) == links


def stem_state(spark, true_pairs, predicted_pairs):
    relations = stems.stem_relations(truth(spark, true_pairs), predicted(spark, predicted_pairs))
    return [(r.state, r.boundary) for r in stems.stem_matches(stems.stem_candidates(relations)).collect()]


def run(i, j, n):
    return [(i + k, j - k) for k in range(n)]


def test_stem_states(spark):
    whole = run(10, 40, 4)
    assert stem_state(spark, whole, whole) == [("exact", "none")]
    assert stem_state(spark, whole, whole[1:]) == [("stem_truncation", "outer")]
    assert stem_state(spark, whole, whole[:-1]) == [("stem_truncation", "inner")]
    assert stem_state(spark, whole, whole[1:-1]) == [("stem_truncation", "both")]
    assert stem_state(spark, whole, run(9, 41, 6)) == [("stem_extension", "both")]
    assert stem_state(spark, whole, run(11, 40, 4)) == [("stem_shift", "none")]
    assert stem_state(spark, whole, run(11, 39, 4)) == [("complex_mismatch", "none")]


def test_ambiguous_component(spark):
    t, p = truth(spark, run(10, 40, 2) + run(13, 37, 2)), predicted(spark, run(10, 40, 5))
    rows = stems.ambiguous_components(stems.stem_candidates(stems.stem_relations(t, p))).collect()
    assert {r.component_id for r in rows} == {"ambiguous_001"} and len(rows) == 3


def test_greedy_match_equals_sequential(spark):
    random.seed(3)
    rows = [("x", "s", l, l + 50, r, r + 50, random.randint(0, 2), random.randint(0, 3), random.randint(4, 6))
            for l, r in itertools.product(range(6), range(6)) if random.random() < 0.5]
    names = "rna_id string, source string, t_left_start int, t_right_end int, p_left_start int, p_right_end int, pair_overlap int, min_arm int, pair_union int"
    got = {(r.t_left_start, r.p_left_start) for r in stems.stem_greedy_match(spark.createDataFrame(rows, names)).collect()}
    left, right, want = set(), set(), set()
    for r in sorted(rows, key=lambda r: (-r[6], -r[7], r[8], r[2], r[3], r[4], r[5])):
        if r[2] not in left and r[4] not in right:
            left.add(r[2]), right.add(r[4]), want.add((r[2], r[4]))
    assert got == want


def test_components_brute_force(spark):
    random.seed(5)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(50)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_running_totals_and_quantiles(spark):
    random.seed(1)
    rows = [("hot" if k % 3 else f"g{k % 7}", round(random.random(), 3), 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, w long").groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = running_totals(value_buckets(df, "v"), ["g"], ["v"], {"c": "w"}, descending=True).collect()
    for r in got[::97]:
        assert r.c == sum(1 for g, v, _ in rows if g == r.g and v >= r.v)
    import numpy as np
    for r in grouped_quantiles(spark.createDataFrame(rows, "g string, v double, w long"), ["g"], "v", [0.0, 0.1, 0.5, 0.95]).collect():
        assert abs(r.quantile - np.quantile([v for g, v, _ in rows if g == r.g], r.level)) < 1e-12


def test_crossing_flag_brute_force(spark):
    random.seed(7)
    rows, want = [], set()
    for k in range(60):
        places = random.sample(range(12), 6)
        made = [tuple(sorted(places[n:n + 2])) for n in (0, 2, 4)]
        rows += [(str(k), i, j) for i, j in made]
        if any(a < c < b < d for (a, b), (c, d) in itertools.permutations(made, 2)):
            want.add(str(k))
    df = spark.createDataFrame(rows, "rna_id string, i int, j int")
    assert {r.rna_id for r in evidence.crossing_structures(df, ["rna_id"]).collect()} == want
    assert {r.rna_id for r in evidence.crossing_pairs(df, ["rna_id"], width=4).collect()} == want


def test_brackets(spark):
    texts = [("ok", "([.)]", 5), ("open", "((.)", 4), ("close", "(.))", 4), ("char", "(?)", 3), ("short", "(.)", 4)]
    valid, rejects = ingest.pairs_from_brackets(spark.createDataFrame(texts, "id string, text string, sequence_length int"), ["id"])
    assert {(r.id, r.i, r.j) for r in valid.collect()} == {("ok", 0, 3), ("ok", 1, 4)}
    assert {r.id: r.code for r in rejects.collect()} == {
        "open": "unmatched_bracket", "close": "unmatched_bracket", "char": "illegal_structure_character", "short": "length_mismatch"}


def test_validate_pairs_first_code(spark):
    rows = [("a", 0, 3, 3, 9), ("b", 0, 5, 2, 9), ("c", 0, 1, 9, 9), ("d", 0, 1, 4, 9), ("d", 1, 1, 4, 9), ("e", 0, 1, 4, 9), ("e", 1, 4, 8, 9), ("f", 0, 1, 4, 9)]
    valid, rejects = validate.validate_pairs(spark.createDataFrame(rows, "id string, ordinal int, i int, j int, sequence_length int"), ["id"])
    assert {r.id: r.code for r in rejects.collect()} == {
        "a": "self_pair", "b": "reversed_pair", "c": "out_of_range_pair", "d": "duplicate_pair", "e": "multiple_partners"}
    assert [r.id for r in valid.collect()] == ["f"]


def test_ranking_and_bins(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    got = reliability.ranking_metrics(df).first()
    assert abs(got.average_precision - 5 / 6) < 1e-12 and got.auroc == 0.875
    edge = spark.createDataFrame([(x, 0) for x in (0.0, 0.1, 0.9, 1.0, 0.09999999)], "score double, label int")
    assert {r.bin_index: r.n for r in reliability.ece_bins(edge).collect() if r.n} == {0: 2, 1: 1, 9: 2}


def test_selected_counts(spark):
    df = spark.createDataFrame([(10, 5, 1), (9, 5, 0), (0, 50, 0)], "size int, percent int, want int")
    row = df.select("want", evidence.rounded_count(F.col("size"), F.col("percent"), False).alias("n"),
                    evidence.rounded_count(F.col("size"), F.col("percent"), True).alias("m")).collect()
    assert [r.n for r in row] == [r.want for r in row] and [r.m for r in row] == [1, 1, 0]


def test_curve_with_fixed_rows(spark):
    rows = [("a", 0.9, 1, False), ("a", 0.2, 0, False), ("a", 0.5, 0, True), ("b", 0.7, 1, False), ("b", 0.7, 0, False)]
    df = spark.createDataFrame(rows, "rna_id string, risk double, label_delete int, fixed boolean")
    got = {r.threshold: r for r in thresholds.threshold_curve(df, "risk", fixed=F.col("fixed")).collect()}
    assert got[None].deleted == 1 and got[0.9].deleted == 2 and got[0.7].deleted == 4
    assert abs(got[0.7].balanced_modification_precision - 0.5) < 1e-12
    assert abs(got[None].event_tp_preservation - 2 / 3) < 1e-12


def test_partition_count_does_not_matter(spark):
    t, p = truth(spark, run(10, 40, 4) + [(2, 50)]), predicted(spark, run(11, 40, 4) + [(2, 50)])
    one, many = [sorted(map(tuple, metrics.pair_status(records(spark, "x"), t.repartition(n), p.repartition(n)).collect())) for n in (1, 8)]
    assert one == many
