"""Plan-shape checks for the scale properties the README claims."""
from receiptflow.plans import q_merge, q_views

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_aggregates_map_side(spark):
    plan = _plan(q_merge.merge_counts(spark, SF))
    assert "partial_min_by" in plan or "partial_min" in plan
    assert "CartesianProduct" not in plan


def test_key_search_has_no_nested_loop(spark):
    plan = _plan(q_views.find_items(spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


def test_catalogue_views_prune_columns(spark):
    plan = _plan(q_views.repeat_purchases(spark, SF))
    # the orders scan reads only the columns the proxy needs
    assert "FileScan parquet" in plan
    assert "o_totalprice" not in plan and "o_orderstatus" not in plan
