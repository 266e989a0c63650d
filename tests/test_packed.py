import pytest
from pyspark.sql import functions as F

from pairscope.operators import packed
from pairscope.plans.all_queries import run
from pairscope.plans.tables import Tables
from pairscope.sources.derived import records

FOLDER = "/root/testdata/sf0.001"
KEYS = ("x5_sample_evidence", "x5_item_index", "x8_payload_hash", "x15_manifest_eligibility", "u9_three_way_actions", "x23_pair_item_totals", "x9_evidence_index",
        "l2_evidence_pooled_features", "l2_pair_pooled_features")


def tables(spark):
    t = Tables(spark, FOLDER)
    t.documents = t.raw("documents").where("doc_id % 7 = 0")
    return t


@pytest.mark.parametrize("key", KEYS)
def test_rnas_too_large_to_be_packed_give_the_same_rows(spark, key, monkeypatch):
    expected = sorted(map(tuple, run(key, tables(spark)).collect()), key=str)
    # lengths are 56, 80 and 104
    monkeypatch.setattr(packed, "LIMIT", 90)
    assert packed.wide_rnas(tables(spark).rnas).count() == records(tables(spark).documents).where("sequence_length = 104").select("rna_id").distinct().count() > 0
    assert sorted(map(tuple, run(key, tables(spark)).collect()), key=str) == expected


def shuffled(spark, key):
    """Rows that a query's shuffles wrote, as a multiple of its RNAs."""
    t = tables(spark)
    out = run(key, t)
    out.collect()
    written, todo = 0, [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name == "Exchange":
                written += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return written / t.documents.count()


@pytest.mark.parametrize("key, most", [("x5_sample_evidence", 5), ("x8_payload_hash", 5), ("x15_manifest_eligibility", 5), ("u9_three_way_actions", 150),
                                       ("l5_masked_control", 150), ("u13_evidence_efficiency", 200), ("x23_pair_item_totals", 50)])
def test_neither_universe_nor_candidates_of_all_manifests_are_shuffled(spark, key, most):
    # an RNA has about 70 universe items and 30 candidates, under 60 manifests each
    assert shuffled(spark, key) < most


def test_digests_are_ordered_by_comparing_values_not_by_a_lambda(spark):
    from pairscope.operators import packed
    from pyspark.sql import functions as F

    rows = spark.sql("SELECT 'r' AS rna_id, 40 AS sequence_length, array() AS none").select("rna_id", "sequence_length", F.expr(
        "transform(sequence(0, 11), k -> struct(cast(k AS int) AS i, cast(40 - k AS int) AS j)) AS pairs"), F.expr(
        "transform(sequence(12, 27), k -> struct(cast(k AS int) AS i, cast(NULL AS int) AS j)) AS free"))
    drawn = packed.sampled(packed.manifests(rows, (20, 50), (101,)))
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    for r in packed.payloads(drawn).collect():
        assert [x["i"] for x in r["items"]] == sorted(x["i"] for x in r["items"]) and len(r["items"]) == r["selected"]
