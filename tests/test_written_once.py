"""Tables that a query reads several times are computed once, and ties are ties."""

from pyspark.sql import functions as F

from pairscope.operators import policy
from pairscope.plans.all_queries import run
from pairscope.plans.tables import Tables


def plan(spark, key):
    return run(key, Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()


def test_stem_candidates_are_computed_once(spark):
    for key in ("t11_stem_error_table", "t12_stem_error_summary", "p1_error_consolidation"):
        assert "AS t_degree" not in plan(spark, key), key


def test_conflicts_are_found_once(spark):
    assert "UNSATISFIABLE" not in plan(spark, "x17_constraint_conflicts")


def test_means_that_differ_by_rounding_only_are_ties(spark):
    rows = spark.createDataFrame([("s", "a", 0.1 + 0.2, 0.5), ("s", "b", 0.3, 0.5), ("s", "c", 0.3 - 1e-8, 0.5)], "stratum string, baseline string, x double, y double")
    found = {r["baseline"]: r["front"] for r in policy.pareto(rows, "x", "y").select("baseline", F.col("front")).collect()}
    assert found == {"a": 1, "b": 1, "c": 0}
