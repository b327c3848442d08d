"""Queries for joins, alert rules, trends and retention (J1, J2, J6, J7, P9,
P10, A3, A19)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.operators import clean as C
from ridgeline.operators import joins as J
from ridgeline.plans import oracle as O
from ridgeline.plans.q_clean import CALC, PREDS, SETTINGS
from ridgeline.plans.registry import query
from ridgeline.sources import sinks as SK
from ridgeline.sources import tables as T
from ridgeline.streaming.live import scratch

R = O.READINGS
FIN = "fin AS (SELECT seq, asset_id, ts, " + ", ".join(
    f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in T.TAGS) + " FROM readings)"
KFIN = f"""
kfin AS (SELECT *, {O.recovery_pct()} / 100.0 AS recovery FROM (SELECT *, {O.grade()} AS grade FROM fin) x)"""


def r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def kfin(spark, sf):
    return T.with_kpis(C.inf_to_null(T.readings(spark, sf)))


def _rules_values():
    rows = []
    for m, p, lo, hi, sev, typ, rec, dec in J.ALERT_RULES:
        lo_s = "'-inf'::DOUBLE" if lo == -J.INF else f"{lo}::DOUBLE"
        hi_s = "'inf'::DOUBLE" if hi == J.INF else f"{hi}::DOUBLE"
        rows.append(f"('{m}', {p}, {lo_s}, {hi_s}, '{sev}', '{typ}', '{rec}', {dec})")
    return ("rules AS (SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(metric, priority, lo, hi, severity, type, recommendation, decimals))")


ALERTS = _rules_values() + ",\n" + """
long AS (UNPIVOT (SELECT seq, asset_id, ts, grade AS concentrate, recovery * 100.0 AS recovery, feed_pb AS feed_grade, kex, sipx FROM kfin)
         ON concentrate, recovery, feed_grade, kex, sipx INTO NAME metric VALUE value),
hits AS (SELECT l.seq, l.asset_id, l.ts, l.metric, l.value, r.priority, r.severity, r.type, r.recommendation, r.decimals
         FROM long l JOIN rules r ON l.metric = r.metric AND l.value > r.lo AND l.value < r.hi),
alerts AS (SELECT seq * 10 + CASE metric WHEN 'concentrate' THEN 0 WHEN 'recovery' THEN 1 WHEN 'feed_grade' THEN 2
                                         WHEN 'kex' THEN 3 ELSE 4 END AS alert_id,
                  seq, asset_id, ts, metric, value, severity, type AS alert_type, recommendation,
                  type || ': ' || CASE WHEN decimals = 1 THEN printf('%.1f', """ + O.rhu("value", 1) + """)
                                       ELSE printf('%.2f', """ + O.rhu("value", 2) + """) END AS description
           FROM (SELECT *, row_number() OVER (PARTITION BY seq, metric ORDER BY priority) AS rk FROM hits) WHERE rk = 1)"""
ACTES = (R, FIN, KFIN, ALERTS)


def alerts(spark, sf):
    return J.threshold_alerts(kfin(spark, sf), J.kpi_metrics())


def dismissals(a):
    """Append-only dismissal events: operators acknowledge every
    medium-severity alert."""
    return a.filter(F.col("severity") == "medium").select("alert_id", F.col("ts").alias("dismissed_at"))


@query("threshold_alerts", O.with_ctes(*ACTES, body="SELECT * EXCLUDE (value), round(value, 6) AS value FROM alerts"))
def threshold_alerts(spark, sf):
    return r6(alerts(spark, sf))


@query("alerts_undismissed", O.with_ctes(*ACTES, body="""
SELECT alert_id, seq, metric, alert_type, severity FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM alerts WHERE severity = 'medium')"""))
def alerts_undismissed(spark, sf):
    a = alerts(spark, sf)
    return J.undismissed(a, dismissals(a)).select("alert_id", "seq", "metric", "alert_type", "severity")


@query("alerts_open", O.with_ctes(*ACTES, body="""
SELECT alert_id, ts, alert_type, severity FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM alerts WHERE severity = 'medium') ORDER BY ts DESC, alert_id DESC LIMIT 50"""))
def alerts_open(spark, sf):
    a = alerts(spark, sf)
    u = J.undismissed(a, dismissals(a))
    return u.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(50).select("alert_id", "ts", "alert_type", "severity")


@query("alerts_by", O.with_ctes(*ACTES, body="""
SELECT alert_id, ts, alert_type, severity FROM alerts WHERE severity = 'high' AND alert_type = 'Low KEX Flow'
ORDER BY ts DESC, alert_id DESC LIMIT 100"""))
def alerts_by(spark, sf):
    a = alerts(spark, sf)
    return (a.filter((F.col("severity") == "high") & (F.col("alert_type") == "Low KEX Flow"))
             .orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(100)
             .select("alert_id", "ts", "alert_type", "severity"))


@query("alert_summary", O.with_ctes(*ACTES, body="""
SELECT metric, count(*) AS n_alerts, least(count(*), 5) AS n_shown, greatest(count(*) - 5, 0) AS n_more FROM alerts GROUP BY metric"""))
def alert_summary(spark, sf):
    return J.alert_summary(alerts(spark, sf))


@query("alerts_shown", O.with_ctes(*ACTES, body="""
SELECT metric, CAST(row_number() OVER (PARTITION BY metric ORDER BY ts, alert_id) AS INTEGER) AS place, alert_id, ts, severity, alert_type, description
FROM alerts QUALIFY place <= 5"""))
def alerts_shown(spark, sf):
    return J.first_alerts(alerts(spark, sf)).select("metric", "place", "alert_id", "ts", "severity", "alert_type", "description")


CALCS = f"""
calcs AS (SELECT seq, asset_id, ts, grade, recovery, {O.status_reagent('grade', 'recovery * 100.0', 'kex', 'sipx')} AS status
          FROM {O.cadence_rows('kfin', T.CALC_MINUTES)} c)"""


def _fb(c):
    if c == "grade":
        inner = "coalesce(feed_pb, 2.0) * (1.0 + (coalesce(kex, 60.0) - 60.0) * 0.1 + (coalesce(sipx, 30.0) - 30.0) * 0.05)"
        return O.rhu(O.clamp(inner, 5.0, 40.0), 2)
    inner = "0.7 + (coalesce(kex, 60.0) - 40.0) * 0.002 + (coalesce(sipx, 30.0) - 20.0) * 0.001"
    return O.rhu(O.clamp(inner, 0.5, 0.95), 3)


@query("hist_combined", O.with_ctes(R, FIN, KFIN, CALCS, body=f"""
SELECT f.seq, f.asset_id, f.ts, f.feed_pb, f.kex, f.sipx,
       round(CASE WHEN c.seq IS NOT NULL THEN c.grade ELSE {_fb('grade')} END, 6) AS grade,
       round(CASE WHEN c.seq IS NOT NULL THEN c.recovery ELSE {_fb('recovery')} END, 6) AS recovery,
       CASE WHEN c.seq IS NOT NULL THEN c.status ELSE 'good' END AS status, c.seq IS NOT NULL AS matched
FROM fin f LEFT JOIN calcs c ON f.asset_id = c.asset_id AND f.ts = c.ts"""))
def hist_combined(spark, sf):
    k = kfin(spark, sf)
    calc = (T.cadence_table(k, T.CALC_MINUTES)
             .withColumn("status", P.status_reagent("grade", F.col("recovery") * 100.0, "kex", "sipx"))
             .select("seq", "asset_id", "ts", "grade", "recovery", "status"))
    r = C.inf_to_null(T.readings(spark, sf)).select("seq", "asset_id", "ts", "feed_pb", "kex", "sipx")
    return r6(J.combine_with_calculated(r, calc))


@query("settings_in_force", O.with_ctes(R, SETTINGS, body="""
SELECT r.asset_id, r.seq, r.ts, s.seq AS setting_seq, s.kex AS set_kex, s.sipx AS set_sipx, s.ts AS valid_from
FROM readings r ASOF LEFT JOIN settings s ON r.asset_id = s.asset_id AND r.ts >= s.ts"""))
def settings_in_force(spark, sf):
    r = T.readings(spark, sf)
    return J.settings_in_force(r.select("asset_id", "seq", "ts"), T.settings(r))


_TREND_METRICS = ["feed_pb", "kex", "sipx", "air_flow", "level", "grade", "recovery_pct"]


@query("trend_analysis", O.with_ctes(R, FIN, KFIN, """
long AS (UNPIVOT (SELECT asset_id, ts, seq, feed_pb, kex, sipx, air_flow, level, grade, recovery * 100.0 AS recovery_pct
                  FROM """ + O.cadence_rows("kfin", T.CALC_MINUTES) + """ c)
         ON feed_pb, kex, sipx, air_flow, level, grade, recovery_pct INTO NAME metric VALUE value)""", """
g AS (SELECT asset_id, metric, count(*) AS n, arg_min(value, (ts, seq)) AS first, arg_max(value, (ts, seq)) AS last,
             avg(value) AS mean, min(value) AS min, max(value) AS max, stddev_pop(value) AS volatility
      FROM long WHERE value IS NOT NULL GROUP BY asset_id, metric)""", body="""
SELECT asset_id, metric, n,
       round(CASE WHEN n >= 2 THEN CASE WHEN first <> 0 THEN (last - first) / first * 100.0 END ELSE 0.0 END, 6) AS change_pct,
       round(CASE WHEN n >= 2 THEN mean ELSE 0.0 END, 6) AS mean, round(CASE WHEN n >= 2 THEN min ELSE 0.0 END, 6) AS min,
       round(CASE WHEN n >= 2 THEN max ELSE 0.0 END, 6) AS max, round(CASE WHEN n >= 2 THEN volatility ELSE 0.0 END, 6) AS volatility,
       CASE WHEN n >= 2 AND (last - first) / nullif(first, 0) * 100.0 > 5 THEN 'increasing'
            WHEN n >= 2 AND (last - first) / nullif(first, 0) * 100.0 < -5 THEN 'decreasing' ELSE 'stable' END AS trend
FROM g"""))
def trend_analysis(spark, sf):
    k = T.cadence_table(kfin(spark, sf), T.CALC_MINUTES)
    metrics = {m: F.col(m) for m in _TREND_METRICS[:-1]}
    metrics["recovery_pct"] = F.col("recovery") * 100.0
    return r6(J.trend_analysis(k, metrics))


CUTOFF = "2024-01-23 00:00:00"


@query("retention_counts", O.with_ctes(R, CALC, SETTINGS, body=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) FILTER (WHERE ts < TIMESTAMP '{CUTOFF}') AS n_deleted, "
    f"count(*) FILTER (WHERE ts >= TIMESTAMP '{CUTOFF}') AS n_kept FROM {t}"
    for n, t in (("sensor", "readings"), ("calculated", "calc"), ("optimization", "settings")))))
def retention_counts(spark, sf):
    r = T.readings(spark, sf)
    tabs = {"sensor": r, "calculated": T.calc(r), "optimization": T.settings(r)}
    return J.retention_counts(tabs, F.lit(CUTOFF).cast("timestamp_ntz"))


#: Within a day, so that whole days go and one is rewritten.
CUTOFF_IN_DAY = datetime(2024, 1, 23, 6, 30)


@query("retention_apply", O.with_ctes(R, SETTINGS, PREDS, body=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n_rows, min(ts) AS first_ts FROM {t} "
    f"WHERE ts >= TIMESTAMP '{CUTOFF_IN_DAY}' GROUP BY ALL"
    for n, t in (("sensor", "readings"), ("settings", "settings"), ("predictions", "preds"), ("events", "events")))))
def retention_apply(spark, sf):
    """P10: four append tables are written by day, expired rows deleted, and
    what is left counted per day."""
    r = T.readings(spark, sf)
    tables = {"sensor": r.select("seq", "ts"), "settings": T.settings(r).select("seq", "ts"),
              "predictions": T.preds(r).select("seq", "ts", "horizon"), "events": T.load(spark, sf, "events").select("event_id", "ts")}
    base, left = scratch(spark, "retention"), []
    for name, df in tables.items():
        path = f"{base}/{name}"
        SK.append_table(df.withColumn("dt", F.to_date("ts")), path)
        SK.apply_retention(spark, path, CUTOFF_IN_DAY, "ts")
        left.append(spark.read.parquet(path).groupBy(F.lit(name).alias("table_name"), F.col("dt").cast("string").alias("dt")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts")))
    return reduce(DataFrame.unionByName, left)
