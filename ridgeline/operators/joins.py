"""Joins (J1, J2, J6, J7) and alert/trend roll-ups.

Small constant tables (rules, ranges) are broadcast: their size is fixed by
the code, not by the data.  Data-sized sides are joined on high-cardinality
keys (asset, ts / alert id), so no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.plans.halo import fill_forward

# --- fixed values that must equal the reference's ---------------------------
# Alert catalogue: (metric, priority, lo, hi, severity, type, recommendation,
# value decimals).  A rule fires when lo < value < hi; per metric the first
# matching rule by priority wins.  Recovery is compared in percent.
INF = float("inf")
ALERT_RULES = [
    ("concentrate", 1, -INF, 10.0, "high", "Low Concentrate", "Check reagent rates and flotation conditions", 2),
    ("concentrate", 2, 40.0, INF, "high", "High Concentrate", "Reduce collector dosage or check feed grade", 2),
    ("concentrate", 3, -INF, 12.0, "medium", "Suboptimal Concentrate", "Adjust KEX or SIPX rates", 2),
    ("concentrate", 4, 30.0, INF, "medium", "Suboptimal Concentrate", "Adjust KEX or SIPX rates", 2),
    ("recovery", 1, -INF, 60.0, "high", "Low Recovery", "Check flotation conditions and reagent effectiveness", 1),
    ("recovery", 2, 95.0, INF, "medium", "High Recovery", "Monitor concentrate grade quality", 1),
    ("recovery", 3, -INF, 65.0, "medium", "Suboptimal Recovery", "Optimize flotation parameters", 1),
    ("feed_grade", 1, -INF, 0.5, "high", "Low Feed Grade", "Check upstream processing and ore quality", 2),
    ("feed_grade", 2, 3.0, INF, "medium", "High Feed Grade", "Adjust flotation parameters for high-grade feed", 2),
    ("kex", 1, -INF, 20.0, "high", "Low KEX Flow", "Check KEX pump and dosing system", 1),
    ("kex", 2, 100.0, INF, "medium", "High KEX Flow", "Verify KEX dosing accuracy", 1),
    ("sipx", 1, -INF, 10.0, "high", "Low SIPX Flow", "Check SIPX pump and dosing system", 1),
    ("sipx", 2, 80.0, INF, "medium", "High SIPX Flow", "Verify SIPX dosing accuracy", 1),
]
METRIC_IDS = {"concentrate": 0, "recovery": 1, "feed_grade": 2, "kex": 3, "sipx": 4}
# ---------------------------------------------------------------------------


def metric_long(df: DataFrame, metrics: dict[str, Column], keys: Sequence[str] = ("seq", "asset_id", "ts")) -> DataFrame:
    """Unpivot named metric Columns to (keys, metric, value), nulls dropped."""
    w = df.select(*keys, *[c.cast("double").alias(n) for n, c in metrics.items()])
    return (w.unpivot(list(keys), list(metrics), "metric", "value")
             .filter(F.col("value").isNotNull()))


def threshold_alerts(df: DataFrame, metrics: dict[str, Column], keys=("seq", "asset_id", "ts")) -> DataFrame:
    """The first matching rule of each metric, as one CASE chain over the
    constant catalogue per metric; no join and no shuffle."""
    hits = []
    for name in [m for m in metrics if m in METRIC_IDS]:
        v, first = F.col("_" + name), F.lit(None)
        for m, _, lo, hi, severity, kind, advice, decimals in sorted(ALERT_RULES, key=lambda r: -r[1]):
            if m == name:
                rule = F.struct(v.alias("value"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"),
                                F.lit(advice).alias("recommendation"), F.lit(decimals).alias("decimals"))
                first = F.when((v > lo) & (v < hi), rule).otherwise(first)
        hits.append(F.struct(F.lit(name).alias("metric"), first.alias("r")))
    values = df.select(*keys, *[c.cast("double").alias("_" + name) for name, c in metrics.items()])
    first = values.select(*keys, F.inline(F.array(*hits))).filter(F.col("r").isNotNull())
    mid = F.lit(0)
    for name, i in METRIC_IDS.items():
        mid = F.when(F.col("metric") == name, F.lit(i)).otherwise(mid)
    return first.select(
        (F.col("seq") * 10 + mid).alias("alert_id"), *keys, "metric", F.col("r.value").alias("value"),
        F.col("r.severity").alias("severity"), F.col("r.type").alias("alert_type"),
        F.col("r.recommendation").alias("recommendation"),
        F.format_string("%s: %s", F.col("r.type"),
                        F.when(F.col("r.decimals") == 1, F.format_number(P.round_half_up(F.col("r.value"), 1), 1))
                         .otherwise(F.format_number(P.round_half_up(F.col("r.value"), 2), 2))).alias("description"))


def kpi_metrics() -> dict[str, Column]:
    """Metrics the alert catalogue watches, from a frame with grade/recovery."""
    return {"concentrate": F.col("grade"), "recovery": F.col("recovery") * 100.0, "feed_grade": F.col("feed_pb"),
            "kex": F.col("kex"), "sipx": F.col("sipx")}


def undismissed(alerts: DataFrame, dismissals: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts with no dismissal event (append-only dismissals, anti join)."""
    return alerts.join(dismissals.select(key).distinct(), key, "left_anti")


def combine_with_calculated(readings: DataFrame, calc: DataFrame, keys=("asset_id", "ts"), order: str = "seq") -> DataFrame:
    """Readings left-joined to calculated values on (asset, ts); the
    right side is deduplicated last-wins (``max_by``); unmatched rows get the
    fallback grade/recovery (F8) and status 'good'."""
    right = (calc.groupBy(*keys).agg(F.max_by(F.struct("grade", "recovery", "status"), order).alias("c"))
                 .select(*keys, F.col("c.grade").alias("c_grade"), F.col("c.recovery").alias("c_recovery"),
                         F.col("c.status").alias("c_status"), F.lit(True).alias("_m")))
    j = readings.join(right, list(keys), "left")
    matched = F.col("_m").isNotNull()
    return j.select(*readings.columns,
                    F.when(matched, F.col("c_grade")).otherwise(P.fallback_grade()).alias("grade"),
                    F.when(matched, F.col("c_recovery")).otherwise(P.fallback_recovery()).alias("recovery"),
                    F.when(matched, F.col("c_status")).otherwise(F.lit("good")).alias("status"),
                    matched.alias("matched"))


def settings_in_force(readings: DataFrame, settings: DataFrame, keys=("asset_id",)) -> DataFrame:
    """Each reading gets the control setting valid at its time: the
    latest setting with ts <= reading ts (valid over [ts, next ts)).  Union +
    chunked forward fill: no range join, no per-asset task."""
    r = readings.select(*keys, "seq", "ts", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("setting_seq"),
                        F.lit(None).cast("double").alias("set_kex"), F.lit(None).cast("double").alias("set_sipx"),
                        F.lit(None).cast("timestamp_ntz").alias("valid_from"))
    s = settings.select(*keys, F.lit(None).cast("long").alias("seq"), "ts", F.lit(0).alias("_kind"),
                        F.col("seq").alias("setting_seq"), F.col("kex").alias("set_kex"), F.col("sipx").alias("set_sipx"),
                        F.col("ts").alias("valid_from"))
    u = r.unionByName(s)
    f = fill_forward(u, list(keys), ["ts", "_kind", "setting_seq"], ["setting_seq", "set_kex", "set_sipx", "valid_from"])
    return f.filter(F.col("_kind") == 1).drop("_kind")


def trend_analysis(df: DataFrame, metrics: dict[str, Column], keys: Sequence[str] = ("asset_id",), ts: str = "ts",
                   tie: str = "seq") -> DataFrame:
    """A3: per key and metric: first, last (by time), % change, mean, min,
    max, population std, class at +-5 % (fewer than 2 values: stable, zeros)."""
    long = metric_long(df, metrics, (*keys, ts, tie))
    order = F.struct(F.col(ts), F.col(tie))
    g = long.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"),
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.stddev_pop("value").alias("volatility"))
    ok = F.col("n") >= 2
    chg = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first") * 100.0)
    return g.select(*keys, "metric", "n",
                    F.when(ok, chg).otherwise(F.lit(0.0)).alias("change_pct"),
                    *[F.when(ok, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("mean", "min", "max", "volatility")],
                    F.when(ok & (chg > 5), "increasing").when(ok & (chg < -5), "decreasing").otherwise("stable").alias("trend"))


def alert_summary(alerts: DataFrame, shown: int = 5) -> DataFrame:
    """Alert count per metric, how many are shown and the remainder."""
    return alerts.groupBy("metric").agg(F.count(F.lit(1)).alias("n_alerts")).select(
        "metric", "n_alerts", F.least(F.col("n_alerts"), F.lit(shown)).alias("n_shown"),
        F.greatest(F.col("n_alerts") - shown, F.lit(0)).alias("n_more"))


def first_alerts(alerts: DataFrame, shown: int = 5) -> DataFrame:
    """The alerts shown per metric, the ``shown`` earliest.  The group
    limit keeps that many per metric and task before the shuffle."""
    w = Window.partitionBy("metric").orderBy("ts", "alert_id")
    return alerts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= shown)


def retention_counts(tables: dict[str, DataFrame], cutoff: Column, ts: str = "ts") -> DataFrame:
    """P10: rows older than the cut-off per table (deleted) and kept."""
    from functools import reduce
    parts = [df.agg(F.lit(name).alias("table_name"), F.count_if(F.col(ts) < cutoff).alias("n_deleted"),
                    F.count_if(F.col(ts) >= cutoff).alias("n_kept")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def retain(df: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    """P10: the kept rows; a row without a timestamp isn't older than the cut-off and stays."""
    return df.filter(F.coalesce(F.col(ts) >= cutoff, F.lit(True)))
