"""Inputs that the derived tables do not hold."""

import random

import pytest
from pyspark.sql import functions as F

from pairscope.operators import agreement, edits, evidence, grouping, metrics, reliability, rules, stems, validate


def test_crossings_with_shared_positions_match_brute_force(spark):
    rng, rows = random.Random(3), []
    for k in range(400):
        for _ in range(rng.randint(0, 5)):
            i, j = sorted(rng.sample(range(9), 2))
            rows.append((str(k), i, j))
    rows = sorted(set(rows))
    pairs = spark.createDataFrame(rows, "rna_id string, i int, j int")
    expected = {(a, i, j, k, l) for a, i, j in rows for b, k, l in rows if a == b and i < k < j < l}
    assert {tuple(r) for r in evidence.crossing_pairs(pairs, ["rna_id"], width=4).collect()} == expected
    assert {r[0] for r in evidence.crossing_structures(pairs, ["rna_id"]).collect()} == {e[0] for e in expected}


def test_more_than_999_ambiguous_components_keep_their_ids(spark):
    rows = []
    for k in range(1_050):
        o = 100 * k
        # two true stems inside one predicted stem
        rows += [("truth", o + n, o + 40 - n) for n in (0, 1, 3, 4)] + [("src", o + n, o + 40 - n) for n in range(5)]
    pairs = spark.createDataFrame(rows, "side string, i int, j int").withColumn("rna_id", F.lit("r"))
    truth = pairs.where("side = 'truth'").select("rna_id", "i", "j")
    predicted = pairs.where("side = 'src'").select("rna_id", F.lit("s").alias("source"), "i", "j")
    candidates = stems.stem_candidates(stems.stem_relations(truth, predicted))
    out = stems.ambiguous_components(candidates)
    ids = {r["component_id"] for r in out.select("component_id").distinct().collect()}
    assert len(ids) == 1_050 and {"ambiguous_001", "ambiguous_999", "ambiguous_1050"} <= ids
    assert out.groupBy("component_id").count().where("count <> 3").isEmpty()


@pytest.mark.parametrize("score, label", [(float("nan"), 1), (0.5, 7), (None, 0), (float("inf"), 0), (0.5, None)])
def test_bad_scores_and_labels_raise(spark, score, label):
    events = spark.createDataFrame([(0.1, 0), (0.9, 1), (score, label)], "score double, label int")
    with pytest.raises(Exception, match="score is not|label is not"):
        reliability.ranking_metrics(events).collect()


def test_contexts_without_pairs_are_counted(spark):
    flags = spark.createDataFrame([("m1", "a", 1, 5, 1, 1, 1)], "manifest_id string, source string, i int, j int, o int, t int, r int")
    contexts = spark.createDataFrame([("m1", "a"), ("m2", "a")], "manifest_id string, source string")
    rows = edits.before_after(edits.edit_decomposition(flags, ["manifest_id", "source"], contexts)).orderBy("manifest_id").collect()
    assert [r["f1_after"] for r in rows] == [1.0, 1.0] and rows[1]["preserved_tp"] == 0 and rows[1]["preservation"] == 1.0


def test_rule_outcomes_with_odd_source_names(spark):
    sources = ["a|b", "a", "x/y"]
    records = spark.createDataFrame([("r", s) for s in sources], "rna_id string, source string")
    truth = spark.createDataFrame([("r", 0, 9), ("r", 1, 8)], "rna_id string, i int, j int")
    predicted = spark.createDataFrame([("r", s, 0, 9) for s in sources] + [("r", "a|b", 2, 6)], "rna_id string, source string, i int, j int")
    deleted = spark.createDataFrame([("R1", "r", "a|b", 2, 6), ("R1", "r", "a", 0, 9)], "condition string, rna_id string, source string, i int, j int")
    out = {(r["condition"], r["source"]): r for r in rules.rule_outcomes(records, truth, predicted, deleted).collect()}
    assert {s for _, s in out} == set(sources) and len(out) == 6 * 3
    assert (out["R1", "a|b"]["beneficial"], out["R1", "a|b"]["harmful"]) == (1, 0)
    assert (out["R1", "a"]["beneficial"], out["R1", "a"]["harmful"]) == (0, 1) and out["R1", "a"]["outcome"] == "NO USEFUL SIGNAL"
    assert out["R1", "x/y"]["sum_tp"] == 1 and out["R1", "x/y"]["sum_fn"] == 1


def test_support_of_more_than_three_sources(spark):
    predicted = spark.createDataFrame([("r", s, 0, 5) for s in "abcde"], "rna_id string, source string, i int, j int")
    assert {(r["support"], r["support_risk"]) for r in agreement.support(predicted, 5).collect()} == {(4, 0)}
    one = spark.createDataFrame([("r", "a", 0, 5), ("r", "b", 0, 5), ("r", "c", 0, 6)], "rna_id string, source string, i int, j int")
    assert {(r["source"], r["support"]) for r in agreement.support(one).collect()} == {("a", 1), ("b", 1), ("c", 0)}


def test_empty_slug_is_a_reject(spark):
    rows = spark.createDataFrame([("A b!",), ("?!",), (None,)], "text string")
    named, rejects = validate.record_ids(rows, F.lit("V 1"), F.col("text"))
    assert [r["record_id"] for r in named.collect()] == ["v_1__a_b"] and [r["code"] for r in rejects.collect()] == ["empty_component"] * 2


def test_similar_sequences_of_any_length_match_brute_force(spark):
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice("AC") for _ in range(rng.randint(1, 12))) for _ in range(160)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    expected = {(a, b) for k, a in enumerate(texts) for b in texts[k + 1:] if distance(a, b) * 5 <= max(len(a), len(b))}
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "rna_id string, sequence string")
    assert {(r["a"], r["b"]) for r in grouping.similar_sequences(rows).collect()} == expected


def test_empty_against_empty_scores_one(spark):
    records = spark.createDataFrame([("r", "a"), ("q", "a")], "rna_id string, source string")
    none = spark.createDataFrame([], "rna_id string, i int, j int")
    predicted = spark.createDataFrame([("q", "a", 0, 5)], "rna_id string, source string, i int, j int")
    rows = {r["rna_id"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.pair_metrics(records, none, predicted).collect()}
    assert rows == {"r": (1.0, 1.0, 1.0), "q": (0.0, 0.0, 0.0)}


def test_corrupted_pairs_follow_the_rules(spark):
    rng = random.Random(4)
    rnas, truth = [], []
    for k in range(12):
        length = rng.randint(12, 40)
        rnas.append((str(k), "".join(rng.choice("ACGU") for _ in range(length)), length))
        truth += [(str(k), i, length - 1 - i) for i in range(length // 3)]
    sequences = {r: s for r, s, _ in rnas}
    pairs = set(truth)
    rna_table = spark.createDataFrame(rnas, "rna_id string, sequence string, sequence_length int")
    true_table = spark.createDataFrame(truth, "rna_id string, i int, j int")
    universe = evidence.evidence_universe(true_table, rna_table)
    manifest_rows = evidence.manifests(universe, rna_table, (50, 90), (1, 2))
    items = evidence.sample_evidence(universe, manifest_rows)
    out = evidence.corrupt_pairs(items, true_table, rna_table, (20, 30)).cache()
    again = {tuple(r) for r in evidence.corrupt_pairs(items.repartition(3), true_table, rna_table, (20, 30)).collect()}
    assert again == {tuple(r) for r in out.collect()}
    cases = {}
    for r in out.collect():
        cases.setdefault((r["manifest_id"], r["noise"]), []).append(r)
    assert sum(r["status"] == "CORRUPTED" for rows in cases.values() for r in rows) > 40
    for (_, noise), rows in cases.items():
        rna, sequence = rows[0]["rna_id"], sequences[rows[0]["rna_id"]]
        asked = [r for r in rows if r["status"] != "CLEAN"]
        assert len(asked) == (len(rows) * noise + 50) // 100
        ends = [e for r in rows if r["i"] is not None for e in (r["i"], r["j"])]
        assert len(ends) == len(set(ends))
        for r in rows:
            if r["status"] == "CLEAN":
                assert (r["i"], r["j"]) == (r["clean_i"], r["clean_j"])
            elif r["status"] == "CORRUPTED":
                assert (rna, r["i"], r["j"]) not in pairs and len({r["i"], r["j"]} & {r["clean_i"], r["clean_j"]}) == 1
                assert sequence[r["i"]] + sequence[r["j"]] in agreement.CANONICAL and r["i"] < r["j"]
            else:
                assert r["i"] is None and r["j"] is None
    one = out.where("noise = 20").drop("noise")
    sized = manifest_rows.where("channel = 'positive_pair'")
    assert evidence.validate_evidence(one, sized, universe, true_table).isEmpty()
    loose = one.withColumn("i", F.when(F.col("status") == "CORRUPTED", F.lit(-1)).otherwise(F.col("i"))).withColumn(
        "j", F.when(F.col("status") == "CORRUPTED", F.lit(-2)).otherwise(F.col("j")))
    assert "endpoint_not_preserved" in {r["finding"] for r in evidence.validate_evidence(loose, sized, universe, true_table).collect()}
