"""Hard conditions and their accounting are made inside the row of an RNA, and give the same rows for RNAs too large for that."""

import pytest
from test_packed import shuffled, tables

from pairscope.operators import packed
from pairscope.plans.all_queries import run

EDITS = ("x10_pair_protect", "x11_pair_enforce", "x12_unpaired_delete", "x22_scope_partition", "x24_edit_decomposition", "x25_edit_counts",
         "x26_evidence_compliance", "x27_scope_metrics", "x28_gain_attribution", "x29_matched_views", "x30_method_compare", "x31_seed_summary")


@pytest.mark.parametrize("key", EDITS)
def test_no_results_of_all_manifests_are_shuffled(spark, key):
    # the results of an RNA are some 2,700 pairs
    assert shuffled(spark, key) < 100


@pytest.mark.parametrize("key", EDITS)
def test_rnas_too_large_to_be_packed_give_the_same_rows(spark, key, monkeypatch):
    # some sources of some RNAs have no pair, and some RNAs no evidence pair
    def few():
        t = tables(spark)
        t.documents = t.raw("documents").where("doc_id % 19 = 0")
        t.predicted = t.predicted.where("source <> 'src_a' OR rna_id % 2 = 0")
        t.truth = t.truth.where("rna_id % 5 <> 0")
        return t

    expected = sorted(map(tuple, run(key, few()).collect()), key=str)
    monkeypatch.setattr(packed, "LIMIT", 90)
    assert packed.wide_rnas(few().rnas).count() > 0
    assert sorted(map(tuple, run(key, few()).collect()), key=str) == expected
