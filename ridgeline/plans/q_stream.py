"""Streaming queries: each runs its stream to completion (availableNow) and
returns the sink as a DataFrame; the DuckDB twin is the batch meaning."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import plugins as PL
from ridgeline.plans import oracle as O
from ridgeline.plans.q_clean import PREDS
from ridgeline.plans.q_joins import ACTES, FIN, KFIN
from ridgeline.plans.q_predictions import r6
from ridgeline.plans.registry import ORACLE
from ridgeline.plans.q_scenario import svc_sql
from ridgeline.plans.registry import query
from ridgeline.streaming import live as L

R = O.READINGS


@query("st_enrich", O.with_ctes(R, FIN, KFIN, body=f"""
SELECT seq, asset_id, ts, round(grade, 6) AS grade, round(recovery, 6) AS recovery,
       {O.status_reagent('grade', 'recovery * 100.0', 'kex', 'sipx')} AS status,
       round({O.rhu('''greatest(0.7, least(0.98, 0.85 + CASE WHEN coalesce(kex, 45.0) BETWEEN 30 AND 60 THEN 0.05 ELSE 0.0 END
             + CASE WHEN coalesce(sipx, 25.0) BETWEEN 15 AND 40 THEN 0.05 ELSE 0.0 END
             + CASE WHEN coalesce(air_flow, 150.0) BETWEEN 100 AND 200 THEN 0.03 ELSE 0.0 END + 0.02))''', 3)}, 6) AS confidence,
       array_to_string({svc_sql()}, ' | ') AS recommendations FROM kfin"""))
def st_enrich(spark, sf):
    out = L.run_to_parquet(L.enrich(L.live_readings(spark, sf)), "enrich")
    return r6(spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("st_snapshot", O.with_ctes(R, body="""
SELECT 2 AS cadence_minutes, asset_id, time_bucket(INTERVAL 2 MINUTE, ts) AS window_start, arg_min(seq, (ts, seq)) AS seq,
       count(*) AS n_points
FROM readings GROUP BY asset_id, time_bucket(INTERVAL 2 MINUTE, ts)
HAVING time_bucket(INTERVAL 2 MINUTE, ts) + INTERVAL 2 MINUTE <= (SELECT max(ts) FROM readings) - INTERVAL 10 MINUTE"""))
def st_snapshot(spark, sf):
    out = L.run_to_parquet(L.snapshots(L.live_readings(spark, sf)), "snapshot")
    return spark.read.parquet(out).withColumn("cadence_minutes", F.col("cadence_minutes").cast("int"))


@query("st_ring_lags", O.with_ctes(R, body="""
SELECT seq, coalesce(lag(kex, 1) OVER w, kex) AS kex_lag1, coalesce(lag(kex, 2) OVER w, kex) AS kex_lag2,
       coalesce(lag(sipx, 1) OVER w, sipx) AS sipx_lag1, coalesce(lag(sipx, 2) OVER w, sipx) AS sipx_lag2
FROM readings WINDOW w AS (PARTITION BY asset_id ORDER BY ts, seq)"""))
def st_ring_lags(spark, sf):
    return spark.read.parquet(L.ring_lags(L.live_readings(spark, sf))).drop("epoch")


@query("st_alerts", O.with_ctes(*ACTES, body="SELECT alert_id, seq, asset_id, ts, metric, round(value, 6) AS value, severity, alert_type FROM alerts"))
def st_alerts(spark, sf):
    out = L.run_to_parquet(L.rule_alerts(L.live_readings(spark, sf)), "alerts")
    return r6(spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("st_burst", O.with_ctes(R, """
w AS (SELECT asset_id, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 10 SECOND * k AS window_start
      FROM readings, (SELECT unnest(range(6)) AS k) kk)""", body="""
SELECT asset_id, window_start, count(*) AS n, count(*) >= 2 AS breach FROM w
GROUP BY asset_id, window_start HAVING window_start + INTERVAL 60 SECOND <= (SELECT max(ts) FROM readings) - INTERVAL 10 MINUTE"""))
def st_burst(spark, sf):
    out = L.run_to_parquet(L.bursts(L.live_readings(spark, sf)), "burst")
    return spark.read.parquet(out)


PREDICTION_DRIFT_SQL = ORACLE["prediction_drift"]


@query("st_drift", PREDICTION_DRIFT_SQL)
def st_drift(spark, sf):
    return r6(L.drift_table(spark, L.drift_monitor(L.live_readings(spark, sf))))


@query("st_accuracy", O.with_ctes(R, PREDS, body="""
SELECT horizon, count(*) AS n, round(avg(abs(actual - prediction)), 6) AS mae, round(avg(pct), 6) AS mean_pct_error,
       round(avg(CAST(pct <= 10 AS DOUBLE)), 6) AS within_10_share, round(avg(greatest(0.0, 100.0 - pct)), 6) AS mean_accuracy
FROM (SELECT p.horizon, p.prediction, a.issue_value AS actual,
             CASE WHEN a.issue_value <> 0 THEN abs(a.issue_value - p.prediction) / a.issue_value * 100.0 ELSE 0.0 END AS pct
      FROM preds p JOIN preds a ON a.horizon = 5 AND a.asset_id = p.asset_id AND a.ts >= p.target_ts AND a.ts < p.target_ts + INTERVAL 5 MINUTE
      WHERE a.issue_value IS NOT NULL AND p.prediction IS NOT NULL) x
GROUP BY horizon"""))
def st_accuracy(spark, sf):
    return r6(L.accuracy_table(spark, L.accuracy_monitor(L.live_readings(spark, sf))))


def _cadence_sql(m):
    w = f"time_bucket(INTERVAL {m} MINUTE, ts)"
    return f"""SELECT {m} AS cadence_minutes, asset_id, {w} AS window_start, arg_min(seq, (ts, seq)) AS seq, count(*) AS n_points
FROM readings GROUP BY asset_id, {w} HAVING {w} + INTERVAL {m} MINUTE <= (SELECT max(ts) FROM readings) - INTERVAL 10 MINUTE"""


@query("st_snapshot_all", O.with_ctes(R, body=" UNION ALL ".join(map(_cadence_sql, L.CADENCES))))
def st_snapshot_all(spark, sf):
    """ST2 at all three cadences, one stream each."""
    parts = [spark.read.parquet(L.run_to_parquet(L.snapshots(L.live_readings(spark, sf), m), f"snapshot-{m}")) for m in L.CADENCES]
    return functools.reduce(DataFrame.unionByName, parts).withColumn("cadence_minutes", F.col("cadence_minutes").cast("int"))


class GradeBands(PL.StatusAnalyser):
    """A foreign analyser: status by grade and recovery bands."""

    requires, statuses = ("grade", "recovery", "kex"), ("low", "good", "high")
    ranges = {"grade": (12.0, 28.0), "recovery": (0.75, 0.9)}

    def status(self):
        lo, hi = self.ranges["grade"]
        return F.when(F.col("kex") == 0, "off").when(F.col("grade") < lo, "low").when(F.col("grade") > hi, "high").when(F.col("grade").isNotNull(), "good")

    def recommendations(self, status):
        return F.when(status == "low", F.array(F.lit("Raise the grade"), F.lit("Check the feed"))).when(status == "high", F.array(F.lit("Save reagent"))).otherwise(
            F.array().cast("array<string>"))


@query("foreign_status", O.with_ctes(R, FIN, KFIN, body="""
SELECT seq, asset_id, status, grade BETWEEN 12.0 AND 28.0 AND recovery BETWEEN 0.75 AND 0.9 AS in_range,
       CASE status WHEN 'low' THEN 'Raise the grade | Check the feed' WHEN 'high' THEN 'Save reagent' ELSE '' END AS recommendations
FROM (SELECT *, CASE WHEN kex = 0 THEN 'unknown' WHEN grade < 12.0 THEN 'low' WHEN grade > 28.0 THEN 'high' ELSE 'good' END AS status FROM kfin) x"""))
def foreign_status(spark, sf):
    """A foreign status analyser on the stream."""
    out = L.run_to_parquet(L.enrich(L.live_readings(spark, sf), GradeBands()), "foreign-status")
    return spark.read.parquet(out).select("seq", "asset_id", "status", "in_range", "recommendations")
