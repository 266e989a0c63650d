"""Row-level evidence tables cover every manifest of the grid."""

import pytest
from pyspark.sql import functions as F

from pairscope.plans.all_queries import run
from pairscope.plans.tables import Tables
from pairscope.sources.derived import DENSITIES, EVIDENCE_SEEDS


@pytest.mark.parametrize("key", ["x23_pair_item_features", "x23_unpaired_item_features"])
def test_item_features_cover_the_grid(spark, key):
    t = Tables(spark, "/root/testdata/sf0.001")
    t.documents = t.raw("documents").where("doc_id % 50 = 0")
    part = F.split("manifest_id", "__")
    found = run(key, t).select(part[3].cast("int").alias("density"), part[4].cast("int").alias("seed")).distinct().collect()
    assert {tuple(r) for r in found} == {(d, s) for d in DENSITIES for s in EVIDENCE_SEEDS if d}
