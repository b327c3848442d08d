"""Plan shape checks: pushdown, pruning, broadcast of bounded sides,
partial aggregation, group limits."""

import __spark_entry__ as E
from datapaths import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_filter_reaches_scan(spark):
    p = _plan(spark, "range_scan")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p


def test_projection_prunes_columns(spark):
    p = _plan(spark, "numeric_only")
    schema = p[p.index("ReadSchema"):].split("\n")[0]
    assert "props" not in schema and "event_type" not in schema


def test_alert_rules_need_no_join_and_no_shuffle(spark):
    p = _plan(spark, "threshold_alerts")
    assert "Join" not in p and "Exchange" not in p


def test_dedupe_is_partial_aggregate(spark):
    p = _plan(spark, "dedupe_last")
    assert "partial_max_by" in p and "Window" not in p


def test_last_n_uses_group_limit(spark):
    assert "WindowGroupLimit" in _plan(spark, "last_n")


def test_scenario_has_no_cross_join(spark):
    p = _plan(spark, "best_scenario")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "partial_max_by" in p


def test_save_cadence_tables_are_partial_aggregates(spark):
    # the calc table comes from a min_by per (asset, window): no window over
    # a whole asset, no id-based filter
    p = _plan(spark, "hist_combined")
    assert "partial_min_by" in p
    assert "% 50" not in p and "% 5)" not in p


def test_hot_key_windows_run_per_chunk(spark):
    # row-frame features are partitioned by (asset, chunk), never by asset alone
    import re
    p = _plan(spark, "roll_basic")
    assert re.search(r"hashpartitioning\(asset_id#\d+L?, _chunk#\d+L?", p)
    assert not re.search(r"hashpartitioning\(asset_id#\d+L?, \d+\)", p)


def test_local_scratch_checkpoint_only_in_local_mode(spark):
    from ridgeline.session import ensure_checkpoint_dir
    assert spark.sparkContext.master.startswith("local")
    assert ensure_checkpoint_dir(spark)


def test_cluster_without_checkpoint_dir_refuses_local_scratch():
    import pytest
    from types import SimpleNamespace
    from ridgeline.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://cluster:7077",
                         setCheckpointDir=lambda d: pytest.fail("must not set a local folder"))
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake)


def test_rule_queries_stay_in_the_jvm(spark):
    # rules are built-in Column expressions: no Python evaluation in the plan
    for name in ("flagship", "hist_combined", "threshold_alerts", "best_scenario", "recommendations",
                 "trend_analysis", "asof_validate"):
        p = _plan(spark, name)
        assert "EvalPython" not in p and "MapInPandas" not in p, name
