"""Corruption and its checks inside a row give what the joins give."""

import random

import pytest
from pyspark.sql import functions as F
from test_packed import shuffled

from pairscope.operators import evidence, noise, packed

LEVELS = (20, 60)


def setup(spark):
    rng, rnas, truth = random.Random(7), [], []
    for k in range(16):
        length = rng.randint(14, 44)
        # few letters that pair, so some items have nowhere to move
        rnas.append((str(k), "".join(rng.choice("ACGU" if k % 2 else "AAAAAC") for _ in range(length)), length))
        truth += [(str(k), i, length - 1 - i) for i in range(length // 3 if k else 0)]
    rna_table = spark.createDataFrame(rnas, "rna_id string, sequence string, sequence_length int")
    true_table = spark.createDataFrame(truth, "rna_id string, i int, j int")
    universe = evidence.evidence_universe(true_table, rna_table)
    manifests = evidence.manifests(universe, rna_table, (0, 50, 90), (1, 2))
    rows = packed.sampled(packed.manifests(noise.packed_for_noise(packed.universes(true_table, rna_table), rna_table), (0, 50, 90), (1, 2)))
    return rna_table, true_table, universe, manifests, noise.corrupted(rows, LEVELS)


def test_corruption_equals_the_joins(spark):
    rnas, truth, universe, manifests, rows = setup(spark)
    items = evidence.sample_evidence(universe, manifests)
    old = evidence.corrupt_pairs(items, truth, rnas, LEVELS)
    for level in LEVELS:
        old = old.unionByName(evidence.corrupt_unpaired(items, truth, level).withColumn("noise", F.lit(level)))
    found = noise.delivered_rows(rows)
    expected = sorted(map(tuple, old.select(*found.columns).collect()), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert {(r[2], r[-1]) for r in expected} == {(c, s) for c in (evidence.PAIR, evidence.UNPAIRED) for s in ("CLEAN", "CORRUPTED", "CORRUPTION_UNAVAILABLE")}


def test_findings_equal_the_joins(spark):
    _, truth, universe, manifests, rows = setup(spark)
    x = lambda c: F.when(F.hash("manifest_id") % 9 == c, F.lit(True)).otherwise(False)
    status = lambda s: (lambda e: e["status"] == s)
    faults = [
        ("i", lambda e: F.when(x(0) & status("CLEAN")(e), e["i"] + 1).otherwise(e["i"])),
        ("i", lambda e: F.when(x(1) & status("CORRUPTED")(e), e["clean_i"]).otherwise(e["i"])),
        ("j", lambda e: F.when(x(1) & status("CORRUPTED")(e), e["clean_j"]).otherwise(e["j"])),
        ("i", lambda e: F.when(x(2) & status("CORRUPTED")(e), -1).otherwise(e["i"])), ("j", lambda e: F.when(x(2) & status("CORRUPTED")(e), -2).otherwise(e["j"])),
        ("i", lambda e: F.when(x(3) & status("CORRUPTED")(e), F.lit(None)).otherwise(e["i"])),
        ("i", lambda e: F.when(x(4) & status("CORRUPTION_UNAVAILABLE")(e), 3).otherwise(e["i"])),
        ("clean_i", lambda e: F.when(x(5), e["clean_i"] + 1).otherwise(e["clean_i"])), ("i", lambda e: F.when(x(6), 2).otherwise(e["i"]))]
    faulty = lambda field, value: F.transform("delivered", lambda e: e.withField(field, value(e)))
    for field, value in faults:
        rows = rows.withColumn("delivered", faulty(field, value))
    wrong = F.col("selected") + F.when(x(7), 1).otherwise(0)
    rows = rows.withColumn("selected", wrong)
    items = noise.delivered_rows(rows)
    sized = manifests.withColumn("selected", wrong).withColumn("noise", F.explode(F.array(*[F.lit(n) for n in LEVELS])))
    expected = sorted(map(tuple, evidence.validate_evidence(items, sized, universe, truth, ["noise", "manifest_id"]).collect()))
    assert sorted(map(tuple, noise.findings(rows).collect())) == expected and len({r[2] for r in expected}) == 8


@pytest.mark.parametrize("key", ["x6_corrupt_pair", "x6_corrupt_unpaired", "x7_validate_evidence", "x7_validate_corruption"])
def test_no_items_of_all_manifests_are_shuffled(spark, key):
    # an RNA has some 310 items, at four levels
    assert shuffled(spark, key) < 50
