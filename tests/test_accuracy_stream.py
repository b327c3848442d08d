"""Validated pairs of the accuracy stream over uneven epochs."""

from pyspark.sql import functions as F

from ridgeline.operators import predictions as PR
from ridgeline.sources import tables as T
from ridgeline.streaming import live as L


def _readings(spark, n=400):
    return spark.range(n).selectExpr("id as seq", "if(id % 50 = 0, null, id % 2) as asset_id", "if(id % 41 = 0, null, timestamp_seconds(1704067200 + id * 47)) as ts",
                                     "if(id % 37 = 0, null, 1 + id % 7D) as feed_pb", "40 + id % 11D as kex", "20 + id % 5D as sipx", "5D as air_flow", "50D as level")


def _pairs(r):
    return PR.due_pairs(T.preds(r).drop("ts"), r.select("asset_id", "ts", T.P.grade_estimate().alias("actual"))).select(
        "seq", "asset_id", "horizon", "target_ts", "actual_ts", "prediction", "actual")


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_pairs_of_uneven_epochs_are_those_of_all_readings_and_a_replay_changes_nothing(spark, tmp_path):
    r, folder = _readings(spark), str(tmp_path / "f")
    cuts = (0, 1, 2, 150, 151, 160, 400, 400)
    for epoch, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for _ in range(2 if epoch in (0, 2, 5) else 1):
            L.accuracy_epoch(L.validated(r.filter(f"seq >= {lo} and seq < {hi}"), epoch, folder), epoch, folder)
    want = _pairs(r)
    assert _sorted(spark.read.parquet(f"{folder}/pairs").drop("epoch")) == _sorted(want) and want.count() > 2000
    assert spark.read.parquet(f"{folder}/state/0/carried").agg(F.min("seq")).first()[0] > 0  # old readings are let go


def test_late_rows_are_left_out_as_by_a_watermark(spark, tmp_path):
    """The rule of the stream-stream join: behind the newest reading of the epochs before the last, less ten minutes."""
    r, folder = _readings(spark).filter("ts is not null"), str(tmp_path / "f")
    late = "seq >= 100 and seq < 110"
    parts = [r.filter("seq < 100"), r.filter("seq >= 110 and seq < 390"), r.filter("seq >= 390"), r.filter(late)]
    for epoch, part in enumerate(parts):
        L.accuracy_epoch(L.validated(part, epoch, folder), epoch, folder)
    mark = r.filter("seq < 390").agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    assert r.filter(late).agg(F.max("ts") + F.expr("interval 60 minutes")).first()[0] < mark
    assert _sorted(spark.read.parquet(f"{folder}/pairs").drop("epoch")) == _sorted(_pairs(r.filter(f"not ({late})")))


def test_pairs_meet_in_a_merge_join_and_are_not_cached(spark, tmp_path):
    """A stream-stream join kept its state in memory; the pairs are as many as readings are dense and were cached."""
    folder = str(tmp_path / "f")
    pairs = L.validated(_readings(spark), 0, folder)
    assert not pairs.isStreaming and "SortMergeJoin" in pairs._jdf.queryExecution().executedPlan().toString()
    L.accuracy_epoch(pairs, 0, folder)
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
