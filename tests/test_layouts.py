"""S8 layouts, epochs that are run again, retention of tables with epochs; S1
scan by name; the message catalogues' edge rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.functions import recs as RC
from ridgeline.sources import layouts as L
from ridgeline.sources import sinks as SK

START = datetime(2024, 1, 1)


def _rows(spark, n, first=0):
    return spark.createDataFrame([(i, START + timedelta(hours=2 * i), float(i), [f"do {i}"]) for i in range(first, first + n)],
                                 "seq int, ts timestamp_ntz, current_kex double, recommendations array<string>")


def test_defaults_names_and_json(spark):
    df = _rows(spark, 2).withColumn("recommendations", F.when(F.col("seq") == 0, F.col("recommendations"))).withColumn("other", F.lit(1))
    rows = L.to_layout(df, "flotation_optimization_data").orderBy("id").collect()
    assert rows[0].asDict().keys() == {"id", "timestamp", "dt", *(f.name for f in L.LAYOUTS["flotation_optimization_data"])}
    assert json.loads(rows[0].recommendations) == ["do 0"] and rows[1].recommendations == "[]"
    assert (rows[0].optimization_confidence, rows[0].external_factors_changed, rows[0].recommended_kex) == (0.8, False, None)
    alert = L.to_layout(_rows(spark, 1), "alerts").first()
    assert (alert.severity, alert.alert_type) == ("warning", None)
    with pytest.raises(TypeError):
        L.to_layout(df.withColumn("recommendations", F.lit("text")), "flotation_optimization_data")
    assert L.to_layout(df.limit(0), "alerts").count() == 0


def test_epoch_run_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    store = lambda df, e: L.append_epoch(L.to_layout(df, "flotation_optimization_data"), path, e)
    store(_rows(spark, 20), 0)
    store(_rows(spark, 20, first=15), 1)  # its days overlap those of epoch 0
    for _ in range(2):
        store(_rows(spark, 20, first=15), 1)
    back = spark.read.parquet(path)
    assert back.count() == 40
    assert back.filter("epoch = 1").agg(F.min("id"), F.max("id"), F.count_distinct("id")).first() == (15, 34, 20)


@pytest.mark.parametrize("hours", [0, 30, 35, 40, 47, 48, 200])
def test_retention_with_epochs(spark, tmp_path, hours):
    path = str(tmp_path / "t")
    for epoch, first in ((0, 0), (1, 10), (2, 20)):
        L.append_epoch(L.to_layout(_rows(spark, 12, first), "control_settings"), path, epoch)
    every = [(i, e) for e, first in ((0, 0), (1, 10), (2, 20)) for i in range(first, first + 12)]
    want = sorted((i, e) for i, e in every if 2 * i >= hours)
    schema = spark.read.parquet(path).schema
    for _ in range(2):  # a second run changes nothing
        SK.apply_retention(spark, path, START + timedelta(hours=hours))
        left = spark.read.schema(schema).parquet(path)
        assert sorted((r.id, r.epoch) for r in left.collect()) == want


def test_scan_monthly_by_name(spark, tmp_path):
    d = tmp_path / "raw.parquet"  # the folder's own name must not be taken for a file's
    d.mkdir()
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    df.toPandas().to_parquet(d / "Pb 2024+02.PARQUET")
    df.drop("b").withColumn("c", F.lit(3)).write.parquet(str(d / "Pb 2024+01.parquet"))
    df.write.parquet(str(d / "Zn 2024+01.parquet"))
    rows = SK.scan_monthly(spark, str(d), "Pb").orderBy("file_no").collect()
    assert [(r.source_file, r.file_no, r.b, r.c) for r in rows] == [("Pb 2024+01.parquet", 0, None, 3), ("Pb 2024+02.PARQUET", 1, 2.0, None)]
    with pytest.raises(FileNotFoundError):
        SK.scan_monthly(spark, str(d), "Cu")


def test_messages_of_missing_values(spark):
    row = spark.range(1).select(
        RC.status_messages(F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("optimal"),
        RC.status_messages(F.lit("critical"), F.lit(None).cast("double"), F.lit(96.0)).alias("critical"),
        RC.multi_horizon_messages(F.lit(None).cast("double"), {5: (F.lit(10.0), F.lit(0.9))}, *[F.lit(1.0)] * 4).alias("failed"),
        RC.multi_horizon_messages(F.lit(0.5), {5: (F.lit(10.0), F.lit(0.65)), 15: (F.lit(12.0), F.lit(None).cast("double"))},
                                  F.lit(40.0), F.lit(20.0), F.lit(42.5), F.lit(20.5)).alias("some"),
        P.status_value(F.lit(None).cast("double"), 15.0, 25.0).alias("s0"), P.status_value(F.lit(14.0), 15.0, 25.0, F.lit("odd")).alias("s1"),
        P.status_value(F.lit(14.0), 15.0, 25.0, F.lit("warning")).alias("s2")).first()
    assert row.optimal == list(RC.STATUS_MSGS["optimal"])
    assert row.critical == [*RC.STATUS_MSGS["critical"], RC.STATUS_VALUE_MSGS["critical", "grade"][1], RC.STATUS_VALUE_MSGS["critical", "recovery"][3]]
    assert row.failed == [RC.MSG_MH_FAILED]
    assert row.some == ["Multi-horizon optimization score: 0.500", "5min: 10.0% Pb (target range) - Confidence: 65.0%",
                        "Increase KEX from 40.0 to 42.5 L/min"]
    assert (row.s0, row.s1, row.s2) == ("optimal", "critical", "warning")
