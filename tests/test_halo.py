"""Chunked (halo) plans equal the plain per-key windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from datapaths import SF_MED
from ridgeline.operators import clean as C
from ridgeline.operators import windows as W
from ridgeline.plans import halo as H
from ridgeline.sources import tables as T


def _base(spark):
    return C.inf_to_null(T.readings(spark, SF_MED)).select("seq", "asset_id", "ts", "feed_pb", "level")


def _collect(df, cols):
    return {r["seq"]: tuple(None if r[c] is None else round(r[c], 9) for c in cols) for r in df.collect()}


@pytest.mark.parametrize("chunk,seed", [(50, 1), (333, 2), (1000, 3), (7, 4)])
def test_row_windowed_equals_global(spark, chunk, seed):
    random.seed(seed)
    lb = min(chunk, random.choice([1, 3, 5]))
    d = _base(spark)

    def build(w):
        return [F.lag("feed_pb", lb).over(w).alias("lag"), F.avg("level").over(w.rowsBetween(-lb, 0)).alias("roll"),
                F.lead("level", 1).over(w).alias("lead")]

    got = H.row_windowed(d, ["asset_id"], ["ts", "seq"], build, lookback=lb, lookahead=1, chunk_rows=chunk)
    ref = d.select("*", *build(Window.partitionBy("asset_id").orderBy("ts", "seq")))
    assert _collect(got, ["lag", "roll", "lead"]) == _collect(ref, ["lag", "roll", "lead"])


@pytest.mark.parametrize("chunk", [13, 500])
def test_fill_forward_equals_global(spark, chunk):
    d = _base(spark).withColumn("feed_pb", F.when(F.col("seq") % 7 < 3, None).otherwise(F.col("feed_pb")))
    got = H.fill_forward(d, ["asset_id"], ["ts", "seq"], ["feed_pb"], chunk_rows=chunk, backward_after=True)
    w = Window.partitionBy("asset_id").orderBy("ts", "seq")
    ref = d.select("seq", *W.fill_gaps(w, ["feed_pb"], order="forward_backward"))
    assert _collect(got, ["feed_pb"]) == _collect(ref, ["feed_pb"])


def _frames(w):
    return [*W.burst_count(w, 1800, 2), *W.irregular_targets(w, "level", horizons=(5,), tol_minutes=30), *W.time_lags(w, ["level"])]


FRAMES = ["n_window", "level_5min_ahead", "level_lag5min", "level_lag60min"]


@pytest.mark.parametrize("chunk", [3, 40, 1000, 1 << 20])
def test_time_windowed_equals_global(spark, chunk):
    d = _base(spark)
    got = H.time_windowed(d, ["asset_id"], "ts", _frames, 3600, 2100, chunk_rows=chunk)
    ref = d.withColumn("_us", H.epoch_micros("ts")).select("seq", *_frames(Window.partitionBy("asset_id").orderBy("_us")))
    assert _collect(got, FRAMES) == _collect(ref, FRAMES)


def test_one_asset_and_day_is_many_tasks(spark):
    """5,000 rows of one asset within one day, some at equal times: no window
    partition holds more than a chunk and the rows its frames reach."""
    d = spark.range(5000).selectExpr("id as seq", "0 as asset_id", "cast(timestamp_seconds(id div 3 * 45) as timestamp_ntz) as ts", "cast(id * 7 % 101 as double) as level")
    count = lambda w: W.burst_count(w, 3600, 2)  # noqa: E731  the same for all rows of a time
    got = H.time_windowed(d, ["asset_id"], "ts", count, 3600, chunk_rows=200)
    ref = d.withColumn("_us", H.epoch_micros("ts")).select("seq", *count(Window.partitionBy("asset_id").orderBy("_us")))
    assert _collect(got, ["n_window"]) == _collect(ref, ["n_window"])
    pos = H.global_positions(d.withColumn("_us", H.epoch_micros("ts")), ["asset_id"], ["_us", "seq"])
    sizes = H.time_chunks(pos, ["asset_id"], 200, 3600, 2100).groupBy("asset_id", "_chunk").count().collect()
    per_second = 3 / 45
    assert len(sizes) == 25 and max(r["count"] for r in sizes) <= 200 + (3600 + 2100 + 90) * per_second


def test_global_positions_are_dense(spark):
    d = _base(spark)
    p = H.global_positions(d, ["asset_id"], ["ts", "seq"], partitions=5)
    got = [r["_gpos"] for r in p.orderBy("asset_id", "ts", "seq").collect()]
    assert got == list(range(d.count()))


def test_windows_plan_partitions_by_chunk(spark):
    d = _base(spark)
    out = H.row_windowed(d, ["asset_id"], ["ts", "seq"], lambda w: W.lag_rows(w, ["feed_pb"], (1,)), 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan
