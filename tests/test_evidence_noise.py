"""Findings on corrupted evidence by noise level and channel."""

from pairscope.operators import evidence
from pairscope.plans.all_queries import QUERIES


def test_findings_are_kept_apart_by_noise(spark):
    universe = spark.createDataFrame([("1", evidence.PAIR, 0, 9), ("1", evidence.PAIR, 1, 8)], "rna_id string, channel string, i int, j int")
    items = spark.createDataFrame(
        [(5, "m", "1", evidence.PAIR, 0, 9, 0, 7, "CORRUPTED"), (30, "m", "1", evidence.PAIR, 0, 9, 3, 7, "CORRUPTED")],
        "noise int, manifest_id string, rna_id string, channel string, clean_i int, clean_j int, i int, j int, status string")
    rows = spark.createDataFrame([(5, "m", 1), (30, "m", 1)], "noise int, manifest_id string, selected int")
    found = evidence.validate_evidence(items, rows, universe, universe.drop("channel"), ["noise", "manifest_id"]).collect()
    assert [tuple(r) for r in found] == [(30, "m", "endpoint_not_preserved")]
    assert "x7_validate_corruption" in QUERIES
