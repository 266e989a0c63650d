"""Pooled item features from ranks against the candidate x item table."""

import random

import pytest
from pyspark.sql import functions as F

from pairscope.operators import edits, pooling

KEY = pooling.KEY


def inputs(spark, channel, seed, width):
    rng = random.Random(seed)
    lengths = [("r1", width), ("r2", 1), ("r3", width // 2 + 2)]
    pair = lambda n: tuple(sorted(rng.sample(range(n), 2)))
    near = lambda n: (lambda i: (i, min(n - 1, i + rng.randint(1, 4))))(rng.randrange(n - 1))
    candidates, items = set(), set()
    for rna, n in lengths:
        if n < 2:
            continue
        found = {pair(n) for _ in range(25)} | {near(n) for _ in range(15)}
        for m in range(3):
            # the first manifest has no items; crossing, shared, equal and repeated endpoints all occur
            pairs = {rng.choice([pair(n), near(n), rng.choice(sorted(found))]) for _ in range(12 * m)}
            positions = {rng.randrange(n) for _ in range(12 * m)}
            items |= {(f"{rna}_{m}", rna, i, j) for i, j in pairs} if channel == "positive_pair" else {(f"{rna}_{m}", rna, k, None) for k in positions}
            candidates |= {(f"{rna}_{m}", rna, s, channel, i, j) for i, j in found for s in ("a", "b") if rng.random() < 0.8}
    return (
        spark.createDataFrame([(*c[:4], 1, 1, *c[4:]) for c in sorted(candidates)],
                              "manifest_id string, rna_id string, source string, channel string, density int, seed int, i int, j int"),
        spark.createDataFrame(sorted(items, key=str), "manifest_id string, rna_id string, i int, j int"),
        spark.createDataFrame(lengths, "rna_id string, sequence_length int"))


@pytest.mark.parametrize("channel, width, seed", [("positive_pair", 90, 1), ("positive_pair", 12_000, 2), ("unpaired", 90, 3), ("unpaired", 12_000, 4)])
def test_pooled_features_equal_the_incidence_table(spark, channel, width, seed):
    candidates, items, lengths = inputs(spark, channel, seed, width)
    pairs = channel == "positive_pair"
    names = edits.PAIR_ITEM_FEATURES if pairs else edits.UNPAIRED_ITEM_FEATURES
    found = (pooling.pair_pooled if pairs else pooling.unpaired_pooled)(candidates, items, lengths)
    rows = (edits.pair_item_features if pairs else edits.unpaired_item_features)(candidates, items, lengths)
    touching = F.col("direct_conflict") if pairs else F.greatest("k_equals_i", "k_equals_j")
    stats = [s for n in names for s in (F.avg(n).alias(f"mean_{n}"), F.max(n).alias(f"max_{n}"))]
    plain = rows.groupBy(*KEY).agg(*stats, F.count("*").alias("item_count"), F.max(touching).alias("e1_local_conflict"),
                                   (F.max("exact_same_pair") if pairs else F.lit(0)).alias("direct_pair_support"))
    wanted = candidates.select(*KEY).join(plain, KEY, "left").fillna(0)
    columns = [c for c in wanted.columns if c not in KEY]
    expected = {tuple(r[k] for k in KEY): [float(r[c]) for c in columns] for r in wanted.collect()}
    got = {tuple(r[k] for k in KEY): [float(r[c]) for c in columns] for r in found.collect()}
    assert got.keys() == expected.keys() and len(got) > 150
    for key, values in expected.items():
        assert got[key] == pytest.approx(values, abs=1e-12), (key, [c for c, a, b in zip(columns, got[key], values) if abs(a - b) > 1e-12])


def test_large_manifests_are_salted(spark, monkeypatch):
    candidates, items, lengths = inputs(spark, "unpaired", 5, 90)
    whole = sorted(map(tuple, edits.unpaired_item_features(candidates, items, lengths).drop("salt").collect()))
    monkeypatch.setattr(edits, "SALTED_ROWS", 50)
    salted = edits.unpaired_item_features(candidates, items, lengths)
    assert salted.select("salt").distinct().count() > 3
    assert sorted(map(tuple, salted.drop("salt").collect())) == whole
