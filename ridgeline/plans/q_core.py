"""Flagship query: clean -> window features -> KPIs -> status counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.operators import windows as W
from ridgeline.operators.clean import clean_and_impute
from ridgeline.plans import oracle as O
from ridgeline.plans.halo import row_windowed
from ridgeline.plans.registry import query
from ridgeline.sources import tables as T

KEYS, ORDER = ["asset_id"], ["ts", "seq"]


def status_by_day(r):
    """W16 -> P2/P1 -> A1 -> P3 -> W5/W11 -> F7/F6 -> F11 -> counts per asset, day, status."""
    c = clean_and_impute(r, T.TAGS)
    feats = row_windowed(
        c, KEYS, ORDER,
        lambda w: [W.rolling_basic(w, ["feed_pb"])[0], *W.rolling_zscore(w, ["level"])],
        lookback=W.ROLL_ROWS - 1)
    k = T.with_kpis(feats)
    st = P.status_reagent("grade", F.col("recovery") * 100.0, "kex", "sipx")
    return (k.withColumn("status", st)
             .groupBy("asset_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "status")
             .agg(F.count(F.lit(1)).alias("n_rows"),
                  F.round(F.avg("feed_pb_roll_mean_30min"), 6).alias("avg_feed_roll_mean"),
                  F.round(F.avg("level_zscore_30min"), 6).alias("avg_level_zscore"),
                  F.round(F.avg("grade"), 6).alias("avg_grade"),
                  F.round(F.avg("recovery"), 6).alias("avg_recovery")))


FLAGSHIP_SQL = O.with_ctes(O.READINGS, """
dup AS (SELECT * FROM readings UNION ALL
        SELECT seq + 1000000 AS seq, asset_id, ts, feed_pb, kex + 1 AS kex, sipx, air_flow, level
        FROM readings WHERE seq % 10 = 0)""", """
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, ts ORDER BY seq DESC) AS rn FROM dup) WHERE rn = 1)""", """
fin AS (SELECT seq, asset_id, ts,
          CASE WHEN isinf(feed_pb) OR isnan(feed_pb) THEN NULL ELSE feed_pb END AS feed_pb,
          CASE WHEN isinf(kex) OR isnan(kex) THEN NULL ELSE kex END AS kex,
          CASE WHEN isinf(sipx) OR isnan(sipx) THEN NULL ELSE sipx END AS sipx,
          CASE WHEN isinf(air_flow) OR isnan(air_flow) THEN NULL ELSE air_flow END AS air_flow,
          CASE WHEN isinf(level) OR isnan(level) THEN NULL ELSE level END AS level FROM dd)""", """
med AS (SELECT quantile_cont(feed_pb, 0.5) AS m_feed, quantile_cont(kex, 0.5) AS m_kex, quantile_cont(sipx, 0.5) AS m_sipx,
               quantile_cont(air_flow, 0.5) AS m_air, quantile_cont(level, 0.5) AS m_level FROM fin)""", """
imp AS (SELECT seq, asset_id, ts, coalesce(feed_pb, m_feed) AS feed_pb, coalesce(kex, m_kex) AS kex,
               coalesce(sipx, m_sipx) AS sipx, coalesce(air_flow, m_air) AS air_flow, coalesce(level, m_level) AS level
        FROM fin, med)""", """
feat AS (SELECT *, avg(feed_pb) OVER w6 AS feed_roll_mean,
                (level - avg(level) OVER w6) / nullif(stddev_samp(level) OVER w6, 0) AS level_z
         FROM imp WINDOW w6 AS (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))""", f"""
g AS (SELECT *, {O.grade()} AS grade FROM feat)""", f"""
k AS (SELECT *, {O.recovery_pct()} AS recovery_pct FROM g)""", body=f"""
SELECT asset_id, strftime(ts, '%Y-%m-%d') AS day, {O.status_reagent()} AS status,
       count(*) AS n_rows, round(avg(feed_roll_mean), 6) AS avg_feed_roll_mean,
       round(avg(level_z), 6) AS avg_level_zscore, round(avg(grade), 6) AS avg_grade,
       round(avg(recovery_pct / 100.0), 6) AS avg_recovery
FROM k GROUP BY ALL""")


@query("flagship", FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    return status_by_day(T.readings_dup(T.readings(spark, sf_dir)))
