import glob

import pytest

from drawdown.plans.catalog import ORACLES, QUERIES
from oracle import compare, duck

SMALL = "/root/testdata/sf0.001"
FAST = ["month_keys", "quality_gate", "train_splits", "peak_detection", "monthly_rollup", "unit_decline_rollup", "group_percentiles", "fit_best", "decline_start",
        "new_entity_rule", "conformal_delta", "economic_limits", "bm25_top", "numeric_audit", "import_issues", "reserve_classes"]


@pytest.mark.skipif(not glob.glob(f"{SMALL}/*.parquet"), reason="test tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, name):
    n, ok, note = compare(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], SMALL)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
