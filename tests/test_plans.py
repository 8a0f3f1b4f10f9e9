"""Plan properties: no cartesian or nested-loop joins, pruned scans."""
import pytest

from quire.plans import queries as Q

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pack_totals", "count_summary", "compare_models", "cost_comparison",
                                  "recommend_model", "resolve_model", "split_by_tokens", "drop_low_priority",
                                  "ignore_rules_per_corpus", "file_tree", "debounced_changes"])
def test_no_pairwise_joins(spark, name):
    plan = _plan(Q.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scan_is_pruned(spark):
    plan = _plan(Q.QUERIES["pack_totals"](spark, SF))
    scans = [l for l in plan.splitlines() if "FileScan parquet" in l]
    assert scans and all("lang" not in l and "n_chars" not in l for l in scans)
