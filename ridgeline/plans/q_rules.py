"""Queries for per-row process rules (F6, F7, F11, F12) with roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.plans import oracle as O
from ridgeline.plans.q_joins import FIN, KFIN, kfin
from ridgeline.plans.q_predictions import r6
from ridgeline.plans.registry import query
from ridgeline.sources import tables as T

R = O.READINGS


@query("grade_estimate", O.with_ctes(R, FIN, body=f"SELECT seq, {O.grade()} AS grade FROM fin"))
def grade_estimate(spark, sf):
    from ridgeline.operators.clean import inf_to_null
    return inf_to_null(T.readings(spark, sf)).select("seq", P.grade_estimate().alias("grade"))


def _rec_training_sql():
    f, c = "coalesce(feed_pb, 1.47)", "grade"
    k, s = "coalesce(kex, 916.30)", "coalesce(sipx, 439.93)"
    a, lv = "coalesce(air_flow, 9.97)", "coalesce(level, 39.01)"
    fac = (f"({O.clamp(f'0.3 - ({k} - 916.30) / 916.30 * 0.1', 0.2, 0.4)} + {O.clamp(f'0.3 - ({s} - 439.93) / 439.93 * 0.08', 0.2, 0.4)}"
           f" + {O.clamp(f'0.3 - ({a} - 9.97) / 9.97 * 0.06', 0.2, 0.4)} + {O.clamp(f'0.3 - ({lv} - 39.01) / 39.01 * 0.04', 0.2, 0.4)}) / 4.0")
    t = f"({f} * {fac})"
    raw = f"(100.0 * ({c} / {f}) * ({f} - {t}) / ({c} - {t}))"
    t2 = f"({c} * 0.8)"
    forced = f"(100.0 * ({c} / {f}) * ({f} - {t2}) / ({c} - {t2}))"
    return f"CASE WHEN {f} > 0 AND {c} > 0 THEN {O.clamp(f'CASE WHEN {c} > {t} THEN {raw} ELSE {forced} END', 80.0, 95.0)} END"


@query("recovery_kpi", O.with_ctes(R, FIN, KFIN, f"""
k2 AS (SELECT *, {_rec_training_sql()} AS recovery_training FROM kfin)""", body="""
SELECT asset_id, hour(ts) // 8 AS shift, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n,
       round(avg(recovery * 100.0), 6) AS avg_recovery_service, round(avg(recovery_training), 6) AS avg_recovery_training,
       round(min(recovery * 100.0), 6) AS min_recovery_service, round(max(recovery_training), 6) AS max_recovery_training
FROM k2 GROUP BY asset_id, hour(ts) // 8, strftime(ts, '%Y-%m-%d')"""))
def recovery_kpi(spark, sf):
    k = kfin(spark, sf).withColumn("recovery_training", P.recovery_two_product(grade="grade", variant="training"))
    return r6(k.groupBy("asset_id", F.floor(F.hour("ts") / 8).cast("bigint").alias("shift"),
                        F.date_format("ts", "yyyy-MM-dd").alias("day"))
               .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("recovery") * 100.0).alias("avg_recovery_service"),
                    F.avg("recovery_training").alias("avg_recovery_training"),
                    F.min(F.col("recovery") * 100.0).alias("min_recovery_service"),
                    F.max("recovery_training").alias("max_recovery_training")))


def _band(v, lo, hi):
    return f"(CASE WHEN {v} < {lo} THEN 'critical' WHEN {v} <= {hi} THEN 'optimal' ELSE 'warning' END)"


@query("process_status", O.with_ctes(R, FIN, KFIN, f"""
st AS (SELECT asset_id, {O.status_reagent('grade', 'recovery * 100.0', 'kex', 'sipx')} AS reagent_status,
              CASE WHEN {_band('grade', 15.0, 35.0)} = 'critical' OR {_band('recovery * 100.0', 75.0, 95.0)} = 'critical' THEN 'critical'
                   WHEN {_band('grade', 15.0, 35.0)} = 'optimal' AND {_band('recovery * 100.0', 75.0, 95.0)} = 'optimal' THEN 'optimal'
                   ELSE 'warning' END AS worst_of_status FROM kfin)""", body="""
SELECT asset_id, reagent_status, worst_of_status, count(*) AS n FROM st GROUP BY asset_id, reagent_status, worst_of_status"""))
def process_status(spark, sf):
    k = kfin(spark, sf)
    return (k.select("asset_id", P.status_reagent("grade", F.col("recovery") * 100.0, "kex", "sipx").alias("reagent_status"),
                     P.status_worst_of("grade", "recovery").alias("worst_of_status"))
             .groupBy("asset_id", "reagent_status", "worst_of_status").agg(F.count(F.lit(1)).alias("n")))


def _pct(v, lo, hi, crit, warn):
    return (f"(CASE WHEN {v} < {lo} * {1 - crit!r} OR {v} > {hi} * {1 + crit!r} THEN 'critical' "
            f"WHEN {v} < {lo} * {1 - warn!r} OR {v} > {hi} * {1 + warn!r} THEN 'warning' ELSE 'optimal' END)")


@query("range_status", O.with_ctes(R, FIN, KFIN, body=f"""
SELECT seq, {_pct('grade', 15.0, 35.0, 0.2, 0.0)} AS grade_status_legacy,
       {_pct('recovery * 100.0', 80.0, 95.0, 0.15, 0.05)} AS recovery_status_realistic,
       CASE WHEN kex >= 40.0 AND kex <= 80.0 THEN 'optimal' ELSE 'warning' END AS kex_control_status,
       CASE WHEN sipx >= 20.0 AND sipx <= 40.0 THEN 'optimal' ELSE 'warning' END AS sipx_control_status
FROM kfin"""))
def range_status(spark, sf):
    k = kfin(spark, sf)
    return k.select("seq", P.status_pct("grade", 15.0, 35.0, 0.2, 0.0).alias("grade_status_legacy"),
                    P.status_pct(F.col("recovery") * 100.0, 80.0, 95.0, 0.15, 0.05).alias("recovery_status_realistic"),
                    P.status_in_range("kex", 40.0, 80.0).alias("kex_control_status"),
                    P.status_in_range("sipx", 20.0, 40.0).alias("sipx_control_status"))


@query("value_status", O.with_ctes(R, FIN, KFIN, body=f"""
SELECT seq, CASE WHEN grade < 15 THEN 'critical' WHEN grade >= 25 THEN 'warning' ELSE 'optimal' END AS grade_status,
       CASE WHEN recovery * 100.0 < 75 THEN 'critical' WHEN recovery * 100.0 >= 95 THEN 'warning' ELSE 'optimal' END AS recovery_status,
       CASE WHEN level IS NOT NULL THEN {O.status_reagent('grade', 'recovery * 100.0', 'kex', 'sipx')}
            WHEN grade < 15 THEN 'critical' WHEN grade >= 25 THEN 'warning' ELSE 'optimal' END AS shown_status
FROM kfin"""))
def value_status(spark, sf):
    """value cut-offs of grade and recovery; the status of the model is
    shown where there is one (here: where the level was measured)."""
    k = kfin(spark, sf)
    known = F.when(F.col("level").isNotNull(), P.status_reagent("grade", F.col("recovery") * 100.0, "kex", "sipx"))
    return k.select("seq", P.status_value("grade", 15.0, 25.0).alias("grade_status"),
                    P.status_value(F.col("recovery") * 100.0, 75.0, 95.0).alias("recovery_status"),
                    P.status_value("grade", 15.0, 25.0, known).alias("shown_status"))


@query("input_confidence", O.with_ctes(R, FIN, body=f"""
SELECT seq, {O.rhu('''greatest(0.7, least(0.98, 0.85 + CASE WHEN coalesce(kex, 45.0) BETWEEN 30 AND 60 THEN 0.05 ELSE 0.0 END
             + CASE WHEN coalesce(sipx, 25.0) BETWEEN 15 AND 40 THEN 0.05 ELSE 0.0 END
             + CASE WHEN coalesce(air_flow, 150.0) BETWEEN 100 AND 200 THEN 0.03 ELSE 0.0 END + 0.02
             + CASE WHEN count(*) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN 0.05 ELSE 0.0 END))''', 3)} AS confidence
FROM fin"""))
def input_confidence(spark, sf):
    from ridgeline.operators.clean import inf_to_null
    from ridgeline.plans.halo import row_windowed
    r = inf_to_null(T.readings(spark, sf))
    h = row_windowed(r, ["asset_id"], ["ts", "seq"],
                     lambda w: [F.count(F.lit(1)).over(w.rowsBetween(-20, -1)).alias("history_rows")], 20)
    return h.select("seq", P.input_confidence(history_rows="history_rows").alias("confidence"))
