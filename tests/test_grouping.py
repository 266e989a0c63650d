"""Nearest reference of every sequence against all pairs; sources left out by name."""

import random

from pairscope.operators import grouping


def distance(a, b):
    row = list(range(len(b) + 1))
    for x, p in enumerate(a, 1):
        before, row[0] = row[0], x
        for y, q in enumerate(b, 1):
            before, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, before + (p != q))
    return row[-1]


def test_every_sequence_has_its_nearest_reference(spark, monkeypatch):
    monkeypatch.setattr(grouping, "BLOCK", 7)
    rng = random.Random(4)
    draw = lambda: "".join(rng.choice("ACGU") for _ in range(rng.randint(1, 30)))
    refs = [(f"r{k:02d}", draw()) for k in range(40)] + [("r90", "ACGU" * 5), ("r91", "ACGU" * 5)]
    fresh = [(f"f{k}", draw()) for k in range(30)] + [("f90", "ACGU" * 5), ("f91", "ACGU" * 4 + "ACGA"), ("f92", "ACGN"), ("f93", "A" * 60), ("f94", None), ("f95", refs[3][1])]
    schema = "rna_id string, sequence string"
    found = {r["rna_id"]: r for r in grouping.nearest_reference(spark.createDataFrame(fresh, schema), spark.createDataFrame(refs, schema)).collect()}
    assert found.keys() == {k for k, _ in fresh} and found["f94"]["identity"] is None
    for name, s in fresh:
        if s is None:
            continue
        scores = [(-(1 - distance(s, r) / max(len(s), len(r))), k) for k, r in refs]
        best = min(scores, key=lambda x: (round(x[0], 9), x[1]))
        assert abs(found[name]["identity"] + best[0]) < 1e-9 and found[name]["nearest"] == best[1]
        reason = "alphabet" if "N" in s else "redundant" if round(-best[0], 9) >= 0.8 else "eligible"
        assert found[name]["reason"] == reason


def test_no_reference_leaves_the_identity_open(spark):
    fresh = spark.createDataFrame([("a", "ACGU")], "rna_id string, sequence string")
    (row,) = grouping.nearest_reference(fresh, fresh.limit(0)).collect()
    assert row["identity"] is None and row["reason"] == "eligible"
