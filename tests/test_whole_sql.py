"""The coverage queries of the whole job against their SQL, on tables large enough for several rounds of cubes."""

import pytest

from tessera.plans import catalog


@pytest.mark.parametrize("name", ["knn_join_whole", "coverage_classify_whole", "head_veto_antijoin_whole"])
def test_whole(spark, same, name):
    same(catalog.QUERIES[name](spark, "/root/testdata/sf0.01"), catalog.SQL[name], "/root/testdata/sf0.01")


def test_unions_are_partial_aggregates(spark):
    plan = catalog.QUERIES["coverage_classify_whole"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "collect_list" not in plan.split("nearest-found")[0]
