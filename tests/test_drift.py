"""Branches of the drift check that whole tables don't reach."""

from datetime import datetime, timedelta

import pytest

from ridgeline.operators import predictions as PR


@pytest.mark.parametrize("n, recent, older, status", [
    (9, None, None, "insufficient"),
    (10, 5.5, 3.0, "drift"),       # the first five are the older ones
    (12, 7.5, 1.5, "drift"),
    (200, 195.5, 95.5, "drift"),
])
def test_prediction_drift_by_length(spark, n, recent, older, status):
    start = datetime(2024, 1, 1)
    rows = [(i, 1, 5, start + timedelta(minutes=i), float(i + 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "seq int, asset_id int, horizon int, ts timestamp_ntz, prediction double")
    got = PR.prediction_drift(df, ["asset_id", "horizon"]).first()
    assert (got.n, got.recent_mean, got.older_mean, got.drift_status) == (n, recent, older, status)
