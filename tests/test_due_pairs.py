"""Predictions meet the actuals of two time buckets, not all of their asset."""

from pyspark.sql import functions as F

from ridgeline.operators import predictions as PR


def _tables(spark, kind):
    at = f"cast(timestamp_seconds(1704067200 + id * 37) as {kind})"
    preds = spark.range(400).selectExpr("id as seq", "if(id % 50 = 0, null, id % 2) as asset_id", "5 as horizon", f"if(id % 41 = 0, null, {at}) as target_ts", "cast(id as double) as prediction")
    actuals = spark.range(300).selectExpr("if(id % 60 = 0, null, id % 2) as asset_id", f"cast(timestamp_seconds(1704067200 + id * 50) as {kind}) as ts", "cast(id as double) as actual")
    return preds, actuals.unionByName(actuals.limit(20))


def test_buckets_give_the_pairs_of_the_plain_interval_join(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        preds, actuals = _tables(spark, kind)
        got = PR.due_pairs(preds, actuals, 7)
        a = actuals.withColumnRenamed("ts", "actual_ts").withColumnRenamed("asset_id", "_a")
        want = preds.join(a, (F.col("asset_id") == F.col("_a")) & F.expr("actual_ts >= target_ts and actual_ts < target_ts + interval 7 minutes")).drop("_a")
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1000


def test_join_key_holds_the_time_bucket(spark):
    preds, actuals = _tables(spark, "timestamp")
    got = PR.due_pairs(preds.hint("merge"), actuals)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(_bucket#" in plan and "= _in#" in plan
