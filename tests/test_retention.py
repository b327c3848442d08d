"""P10: retention deletes expired rows from an append table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgeline.sources import sinks as SK

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("cutoff", [
    START,                             # nothing expired
    START + timedelta(days=2),         # whole days only
    START + timedelta(days=2, hours=7),  # whole days, and one rewritten
    START + timedelta(days=4, hours=23, minutes=59),  # no row of the edge day stays
    START + timedelta(days=30),        # everything expired
])
def test_apply_retention(spark, tmp_path, cutoff):
    rows = [(i, START + timedelta(hours=3 * i)) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "seq int, timestamp timestamp_ntz").withColumn("dt", F.to_date("timestamp"))
    path = str(tmp_path / "sensor")
    SK.append_table(df, path)
    want = {i for i, ts in rows if ts is None or ts >= cutoff}
    for _ in range(2):  # a second run changes nothing
        SK.apply_retention(spark, path, cutoff)
        left = spark.read.schema(df.schema).parquet(path)
        assert {r.seq for r in left.collect()} == want and left.count() == len(want)
    days = {p.name for p in (tmp_path / "sensor").glob("dt=2*")}
    assert days == {f"dt={ts.date()}" for i, ts in rows if i in want and ts}
