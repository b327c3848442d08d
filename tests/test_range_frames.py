"""Range frames are looked up, whatever the number of rows they cover."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.operators import windows as W
from ridgeline.plans import halo as H


def _frames(w):
    return [*W.burst_count(w, 60, 3), *W.irregular_targets(w, "v", horizons=(1, 2), tol_minutes=1), *W.time_lags(w, ["v"], minutes=(1, 2), latest_minutes=(1,))]


OUT = ["n_window", "breach", "v_1min_ahead", "v_2min_ahead", "v_lag1min", "v_lag2min"]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_frames_with_nulls_equal_plain_windows(spark, chunk):
    """Null values, null keys and empty frames; rows of one time have one value."""
    df = spark.range(600).selectExpr("id as seq", "if(id % 9 = 0, null, id % 2) as asset_id", "cast(timestamp_seconds(id div 4 * 23) as timestamp_ntz) as ts",
                                     "if(id div 4 % 5 = 0, null, cast(id div 4 as double)) as v")
    got = H.time_windowed(df, ["asset_id"], "ts", _frames, 120, 180, chunk_rows=chunk)
    ref = df.withColumn("_us", H.epoch_micros("ts")).select("*", *_frames(Window.partitionBy("asset_id").orderBy("_us"))).drop("_us")
    assert got.columns == ref.columns and [f.dataType for f in got.schema] == [f.dataType for f in ref.schema]
    assert {r.seq: tuple(r[c] for c in OUT) for r in got.collect()} == {r.seq: tuple(r[c] for c in OUT) for r in ref.collect()}


def test_rows_without_a_time_frame_each_other(spark):
    df = spark.range(30).selectExpr("id as seq", "0 as asset_id", "if(id < 6, null, cast(timestamp_seconds(id * 600) as timestamp_ntz)) as ts", "1.0d as v")
    got = H.time_windowed(df, ["asset_id"], "ts", lambda w: W.burst_count(w, 60, 3), 60)
    assert {r.seq: r.n_window for r in got.collect()} == {i: 6 if i < 6 else 1 for i in range(30)}


def test_frames_are_not_slid_by_spark(spark):
    df = spark.range(10).selectExpr("id as seq", "0 as asset_id", "cast(timestamp_seconds(id) as timestamp_ntz) as ts", "1.0d as v")
    got = H.time_windowed(df, ["asset_id"], "ts", _frames, 120, 180)
    assert "RangeFrame" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
