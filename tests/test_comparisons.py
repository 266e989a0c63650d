"""Comparisons of methods, policies and baselines on small tables, counted by hand or in plain Python."""

import random
from collections import Counter

import pytest

from pairscope.operators import edits, policy, thresholds


def test_methods_against_both_baselines(spark):
    pairs = lambda rows: spark.createDataFrame([("m1", r, "s", i, j) for r, i, j in rows], "manifest_id string, rna_id string, source string, i int, j int")
    original = pairs([("r1", 0, 9), ("r1", 2, 7), ("r2", 1, 5)])
    truth = pairs([("r1", 0, 9), ("r1", 1, 8), ("r2", 1, 6)])
    local = pairs([("r1", 0, 9), ("r1", 1, 8), ("r2", 1, 5)])
    contexts = spark.createDataFrame([("m1", "r1", "s", 1), ("m1", "r2", "s", 0), ("m1", "r3", "s", 0)], "manifest_id string, rna_id string, source string, items int")
    parts = edits.method_parts(original, truth, {"B1": local, "B2": original.limit(0)}, contexts)
    assert parts.count() == 9
    rows = {r["method"]: r for r in edits.compare_methods(parts, ["source"], "B1").collect()}
    base, hard, none = rows[edits.ORIGINAL], rows["B1"], rows["B2"]
    # r1: one right of two, r2: none of one, r3: empty on both sides
    assert base["micro_f1"] == pytest.approx(2 / 6) and base["macro_f1"] == pytest.approx((0.5 + 0 + 1) / 3) and base["micro_delta_f1_vs_b0"] == 0
    assert hard["micro_f1"] == pytest.approx(4 / 6) and hard["macro_f1"] == pytest.approx(2 / 3)
    assert hard["micro_delta_f1_per_evidence_item"] == pytest.approx(4 / 6 - 2 / 6)
    assert (hard["macro_delta_f1_per_evidence_item"], hard["macro_delta_f1_per_evidence_item_defined"]) == (pytest.approx(0.5), 1)
    assert (hard["removed_fp"], hard["new_tp"], hard["lost_tp"], hard["micro_modification_precision"]) == (1, 1, 0, 1.0)
    assert none["micro_f1"] == 0 and none["micro_delta_f1_vs_b1"] == pytest.approx(-4 / 6) and none["micro_tp_preservation"] == 0
    assert base["micro_modification_precision"] is None and base["macro_tp_preservation_defined"] == 1


def test_marginal_breakdown_matches_plain_counts(spark):
    rng = random.Random(8)
    names = "source channel scope density raw_separation normalized_stem_position singleton_flag outer_boundary_flag inner_boundary_flag pair_type support risk_a risk_b label_delete del_a del_b".split()
    rows = [(rng.choice("ab"), rng.choice(["pair", "unpaired"]), rng.choice(["DIRECT", "LOCAL_CONFLICT", "NON_EVIDENCED", "NON_EVIDENCED"]), rng.choice([5, 50]),
             rng.choice([4, 9, 10, 19, 20, 49, 50, 99, 100, 500]), rng.choice([0.0, 0.24, 0.25, 0.5, 0.75, 1.0]), rng.randrange(2), rng.randrange(2), rng.randrange(2),
             rng.choice(["AU", "GG"]), rng.randrange(3), rng.randrange(101) / 100, rng.randrange(101) / 100, rng.randrange(2), rng.random() < 0.4, rng.random() < 0.4) for _ in range(500)]
    found = {(r["dimension"], r["stratum"]): r for r in policy.marginal_breakdown(spark.createDataFrame(rows, names), 5).collect()}
    everywhere = {"scope": 2, "source_all_scopes": 0, "channel_all_scopes": 1}
    separation = lambda v: next(n for top, n in ((9, "04-09"), (19, "10-19"), (49, "20-49"), (99, "50-99"), (1e9, "100+")) if v <= top)
    outside = {"source": lambda r: r[0], "evidence_density": lambda r: str(r[3]), "sequence_separation": lambda r: separation(r[4]), "pair_type": lambda r: r[9],
               "p2_agreement": lambda r: f"{r[10]}_of_2_other_sources",
               "boundary_status": lambda r: "SINGLETON" if r[6] else ("STEM_INTERIOR", "OUTER_BOUNDARY", "INNER_BOUNDARY", "BOTH_BOUNDARIES")[r[7] + 2 * r[8]],
               "calibrated_risk": lambda r: (lambda k: f"[{k / 10:.1f},{(k + 1) / 10:.1f}{']' if k == 9 else ')'}")(min(int(r[11] * 10), 9))}
    expected = Counter()
    for r in rows:
        keys = [(d, r[k]) for d, k in everywhere.items()]
        keys += [(d, of(r)) for d, of in outside.items()] if r[2] == "NON_EVIDENCED" else []
        for key in keys:
            expected[(*key, "n")] += 1
            expected[(*key, "only_a_removed")] += r[13] == 1 and r[14] and not r[15]
            expected[(*key, "lost_b")] += r[13] == 0 and r[15]
    assert len({d for d, _ in found}) == 15
    for (d, s, c), n in expected.items():
        assert found[(d, s)][c] == n
    assert all(r["mean_n"] == r["n"] / 5 for r in found.values())


def test_strongest_baseline_needs_the_bar_and_tells_of_sources(spark):
    schema = ("baseline string, tp_preservation double, rna_tp_preservation double, rna_fp_removal double, rna_modification_precision double, deleted int, "
              "rna_average_precision double")
    rows = [("greedy", 0.9, 0.9, 0.9, 0.9, 9, 0.9), ("b", 0.995, 0.99, 0.5, None, 3, 0.4), ("a", 0.995, 0.995, 0.5, 0.7, 5, 0.4), ("c", 1.0, 1.0, 0.5, 0.7, 5, 0.3)]
    split = "baseline string, source string, tp_preservation double, rna_tp_preservation double, rna_delta_f1 double"
    same = spark.createDataFrame([("a", s, 1.0, 1.0, 0.1) for s in "xy"], split)
    (best,) = thresholds.strongest_baseline(spark.createDataFrame(rows, schema), same).collect()
    assert (best["baseline"], best["eligible_baselines"], best["source_dependence"]) == ("a", 3, "NO_SOURCE_SAFETY_FAILURE_AT_0.99")
    mixed = spark.createDataFrame([("a", "x", 1.0, 1.0, 0.1), ("a", "y", 1.0, 1.0, -0.1)], split)
    assert thresholds.strongest_baseline(spark.createDataFrame(rows, schema), mixed).first()["source_dependence"] == "SOURCE_DEPENDENT_COMPARATOR"
    (nothing,) = thresholds.strongest_baseline(spark.createDataFrame(rows[:1], schema), same).collect()
    assert nothing["status"] == "NO_HIGH_PRESERVATION_ELIGIBLE_BASELINE" and nothing["source_dependence"] is None


def test_deployability_counts_runs_and_sources(spark):
    rows = [("x", f, 0.9, 1) for f in range(3)] + [("x", f, 0.1, 0) for f in range(3)] + [("y", 0, 0.9, 1), ("y", 1, 0.99, 0), ("y", 1, 0.2, 1), ("y", 2, 0.3, 0)]
    events = spark.createDataFrame(rows, "source string, fold int, risk double, label_delete int")
    found = {r["scope"]: (r["runs"], r["usable"]) for r in thresholds.deployability(events, "risk", ["fold"]).collect()}
    assert found["x"] == (3, 3) and found["y"][0] == 3 and found["y"][1] < 3 and found["ALL_SOURCES"][1] <= found["y"][1] and found["GLOBAL"][0] == 3
