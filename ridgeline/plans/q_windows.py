"""Queries for ordered window features (W1-W24 except prediction ones) and
row-level feature functions (F1-F5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.functions import calendar as CAL
from ridgeline.functions.process import round_half_up
from ridgeline.operators import clean as C
from ridgeline.operators import windows as W
from ridgeline.plans import halo as H
from ridgeline.plans import oracle as O
from ridgeline.plans.registry import query
from ridgeline.sources import tables as T

KEYS, ORDER = ["asset_id"], ["ts", "seq"]
R = O.READINGS
FIN = "fin AS (SELECT seq, asset_id, ts, " + ", ".join(
    f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in T.TAGS) + " FROM readings)"
WSPEC = "WINDOW w AS (PARTITION BY asset_id ORDER BY ts, seq)"


def base(spark, sf):
    return C.inf_to_null(T.readings(spark, sf))


def r6(cols):
    return [F.round(F.col(c), 6).alias(c) if isinstance(c, str) else c for c in cols]


def run_rows(spark, sf, build, lookback, lookahead=0, cols=("feed_pb", "level"), df=None):
    d = df if df is not None else base(spark, sf)
    out = H.row_windowed(d, KEYS, ORDER, build, lookback, lookahead)
    names = [c for c in out.columns if c not in d.columns]
    return out.select("seq", *r6(names))


def sql_rows(exprs: list[tuple[str, str]], src="fin", extra_ctes=()) -> str:
    sel = ", ".join(f"{e} AS {n}" if e.startswith('(floor') else f"round({e}, 6) AS {n}" for n, e in exprs)
    return O.with_ctes(R, FIN, *extra_ctes, body=f"SELECT seq, {sel} FROM {src} {WSPEC}")


@query("lag_rows", sql_rows([(f"{c}_lag_{k}", f"lag({c}, {k}) OVER w") for c in ("feed_pb", "level") for k in range(1, 6)]))
def lag_rows(spark, sf):
    return run_rows(spark, sf, lambda w: W.lag_rows(w, ["feed_pb", "level"]), 5)


_LAGM = [(f"{c}_lag{m}min", f"coalesce(lag({c}, {m // 5}) OVER w, avg({c}) OVER (PARTITION BY asset_id))")
         for c in ("feed_pb", "kex") for m in (5, 15, 30, 60)]


@query("lag_minutes", sql_rows(_LAGM))
def lag_minutes(spark, sf):
    d = base(spark, sf)
    means = d.groupBy("asset_id").agg(F.avg("feed_pb").alias("_m_feed_pb"), F.avg("kex").alias("_m_kex"))
    d = d.join(means, "asset_id")
    out = H.row_windowed(d, KEYS, ORDER, lambda w: W.lag_minutes(
        w, ["feed_pb", "kex"], step_minutes=5, means={"feed_pb": F.col("_m_feed_pb"), "kex": F.col("_m_kex")}), 12)
    return out.select("seq", *r6([n for n, _ in _LAGM]))


def _tl_sql():
    parts = []
    for c in ("feed_pb", "kex"):
        for m in (5, 15, 30, 60):
            fn = "last_value" if m == 5 else "first_value"
            fr = (f"OVER (PARTITION BY asset_id ORDER BY ts RANGE BETWEEN INTERVAL {m} MINUTE PRECEDING "
                  f"AND INTERVAL 1 MICROSECOND PRECEDING)")
            parts.append((f"{c}_lag{m}min", f"CASE WHEN rn <= 10 THEN {c} ELSE coalesce({fn}({c}) {fr}, {c}) END"))
    return parts


_TL = _tl_sql()


@query("lag_time", O.with_ctes(R, FIN, "fr AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts, seq) AS rn FROM fin)",
                               body="SELECT seq, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _TL) + " FROM fr"))
def lag_time(spark, sf):
    d = base(spark, sf)
    first = W.first_n_flags(d, KEYS, ORDER, 10).withColumn("_few", F.lit(True))
    d = d.join(first, ["asset_id", "seq"], "left")
    few = F.coalesce(F.col("_few"), F.lit(False))
    out = H.time_windowed(d, KEYS, "ts", lambda w: W.time_lags(w, ["feed_pb", "kex"], few_history=few),
                          lookback_seconds=3600)
    return out.select("seq", *r6([n for n, _ in _TL]))


@query("lag_pair", sql_rows([(f"{c}_lag{k}", f"coalesce(lag({c}, {k}) OVER w, {c})") for c in ("kex", "sipx") for k in (1, 2)]))
def lag_pair(spark, sf):
    return run_rows(spark, sf, lambda w: W.lag_pair(w, ["kex", "sipx"]), 2)


F6 = "OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query("roll_basic", sql_rows([(f"{c}_roll_{s}_30min", f"{fn}({c}) {F6}") for c in ("feed_pb", "level")
                               for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]))
def roll_basic(spark, sf):
    return run_rows(spark, sf, lambda w: W.rolling_basic(w, ["feed_pb", "level"]), 5)


FL = "OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING)"


@query("roll_of_lag", sql_rows([(f"{c}_lag3_roll_{s}_30min", f"{fn}({c}) {FL}") for c in ("kex",)
                                for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]))
def roll_of_lag(spark, sf):
    return run_rows(spark, sf, lambda w: W.rolling_of_lag(w, ["kex"], 3, 6), 8)


_RM = [(f"{c}_rolling_{s}_{n}min",
        f"coalesce({fn}({c}) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), "
        f"avg({c}) OVER (PARTITION BY asset_id))")
       for c in ("sipx",) for n in (5, 15, 30) for s, fn in (("mean", "avg"), ("std", "stddev_samp"))]


@query("roll_multi", sql_rows(_RM))
def roll_multi(spark, sf):
    d = base(spark, sf)
    d = d.join(d.groupBy("asset_id").agg(F.avg("sipx").alias("_m_sipx")), "asset_id")
    out = H.row_windowed(d, KEYS, ORDER, lambda w: W.rolling_multi(w, ["sipx"], means={"sipx": F.col("_m_sipx")}), 29)
    return out.select("seq", *r6([n for n, _ in _RM]))


@query("rate_of_change", sql_rows([(f"{c}_rate_of_change", f"{c} - lag({c}, 1) OVER w") for c in ("feed_pb", "air_flow")]))
def rate_of_change(spark, sf):
    return run_rows(spark, sf, lambda w: W.rate_of_change(w, ["feed_pb", "air_flow"]), 1)


@query("acceleration", sql_rows([(f"{c}_acceleration", f"{c} - 2 * lag({c}, 1) OVER w + lag({c}, 2) OVER w")
                                 for c in ("feed_pb", "air_flow")]))
def acceleration(spark, sf):
    return run_rows(spark, sf, lambda w: W.acceleration(w, ["feed_pb", "air_flow"]), 2)


@query("momentum", sql_rows([(f"{c}_momentum_5min", f"coalesce({c} - lag({c}, 5) OVER w, 0.0)") for c in ("feed_pb", "level")]))
def momentum(spark, sf):
    return run_rows(spark, sf, lambda w: W.momentum(w, ["feed_pb", "level"]), 5)


@query("roll_zscore", sql_rows([(f"{c}_zscore_30min", f"({c} - avg({c}) {F6}) / nullif(stddev_samp({c}) {F6}, 0)")
                                for c in ("feed_pb", "air_flow")]))
def roll_zscore(spark, sf):
    return run_rows(spark, sf, lambda w: W.rolling_zscore(w, ["feed_pb", "air_flow"]), 5)


@query("roll_quantile", sql_rows([(f"{c}_p{p}_30min", f"quantile_cont({c}, {p / 100}) {F6}") for c in ("feed_pb", "air_flow")
                                  for p in (25, 75)]))
def roll_quantile(spark, sf):
    return run_rows(spark, sf, lambda w: W.rolling_quantiles(w, ["feed_pb", "air_flow"]), 5)


def _shape(c):
    n = f"CAST(count({c}) {F6} AS DOUBLE)"
    ok = f"stddev_pop({c}) {F6} > 0"
    return [(f"{c}_skew_{'30min'}", O.rhu(f"round(CASE WHEN {n} >= 3 AND {ok} THEN skewness({c}) {F6} END, 9)", 6)),
            (f"{c}_kurt_{'30min'}", O.rhu(f"round(CASE WHEN {n} >= 4 AND {ok} THEN kurtosis({c}) {F6} END, 9)", 6))]


# moments of short frames of discretised data are short decimals that often sit
# exactly on a rounding tie; both sides snap to 9 decimals, then round half-up
# with plain IEEE arithmetic
@query("roll_shape", sql_rows(_shape("air_flow") + _shape("level")))
def roll_shape(spark, sf):
    d = base(spark, sf)
    out = H.row_windowed(d, KEYS, ORDER, lambda w: W.rolling_shape(w, ["air_flow", "level"]), 5)
    names = [c for c in out.columns if c not in d.columns]
    return out.select("seq", *[round_half_up(F.round(c, 9), 6).alias(c) for c in names])


@query("fill_gaps", O.with_ctes(R, FIN, body="""
SELECT seq, asset_id, ts,
       coalesce(last_value(feed_pb IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(feed_pb IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS feed_pb,
       coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(level IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
FROM fin"""))
def fill_gaps(spark, sf):
    d = base(spark, sf).select("seq", "asset_id", "ts", "feed_pb", "level")
    return H.fill_forward(d, KEYS, ORDER, ["feed_pb", "level"], backward_after=True)


@query("moving_avg", O.with_ctes(R, FIN, body="""
SELECT seq, ts, round(CASE WHEN count(feed_pb) OVER w10 = 10 THEN avg(feed_pb) OVER w10 END, 6) AS feed_pb_ma10
FROM fin WHERE feed_pb IS NOT NULL
WINDOW w10 AS (PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def moving_avg(spark, sf):
    d = base(spark, sf).filter(F.col("feed_pb").isNotNull())
    out = H.row_windowed(d, KEYS, ORDER, lambda w: W.moving_average_full(w, "feed_pb", 10), 9)
    return out.select("seq", "ts", F.round("feed_pb_ma10", 6).alias("feed_pb_ma10"))


@query("horizon_targets", O.with_ctes(R, FIN, f"g AS (SELECT *, {O.grade()} AS grade FROM fin)", body=f"""
SELECT seq, {", ".join(f"lead(grade, {max(1, h // 5)}) OVER w AS grade_{h}min_ahead" for h in (5, 15, 30, 60))}
FROM g {WSPEC}"""))
def horizon_targets(spark, sf):
    from ridgeline.functions.process import grade_estimate
    d = base(spark, sf).withColumn("grade", grade_estimate())
    out = H.row_windowed(d, KEYS, ORDER, lambda w: W.horizon_targets(w, "grade"), 0, lookahead=12)
    return out.select("seq", *[f"grade_{h}min_ahead" for h in (5, 15, 30, 60)])


@query("lag_ratio", sql_rows([(f"feed_pb_ratio_lag{m}min",
                               f"feed_pb / (CASE WHEN lag(feed_pb, {m // 5}) OVER w = 0 THEN 1.0 ELSE lag(feed_pb, {m // 5}) OVER w END)")
                              for m in (5, 15, 30, 60)]))
def lag_ratio(spark, sf):
    return run_rows(spark, sf, lambda w: W.lag_ratio(w, ["feed_pb"], step_minutes=5), 12)


@query("last_n", O.with_ctes(R, body="""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, seq DESC) AS rn FROM readings)
WHERE rn <= 100"""))
def last_n(spark, sf):
    return W.keep_last_n(T.readings(spark, sf), KEYS, ORDER, 100)


@query("burst_detect", O.with_ctes(R, body="""
SELECT seq, n_window, n_window >= 5 AS breach FROM (
  SELECT seq, count(*) OVER (PARTITION BY asset_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n_window
  FROM readings)"""))
def burst_detect(spark, sf):
    out = H.time_windowed(T.readings(spark, sf), KEYS, "ts", lambda w: W.burst_count(w, 3600, 5),
                          lookback_seconds=3600)
    return out.select("seq", "n_window", "breach")


@query("external_change", O.with_ctes(R, FIN, body=f"""
SELECT seq, coalesce(abs(feed_pb - lag(feed_pb, 1) OVER w) > 0.1, false) AS external_change FROM fin {WSPEC}"""))
def external_change(spark, sf):
    out = H.row_windowed(base(spark, sf), KEYS, ORDER, lambda w: W.external_change(w), 1)
    return out.select("seq", "external_change")


@query("cadence_snapshot", O.with_ctes(R, body=" UNION ALL ".join(f"""
SELECT {k} AS cadence_minutes, asset_id, time_bucket(INTERVAL {k} MINUTE, ts) AS window_start, arg_min(seq, ts) AS seq, count(*) AS n_points
FROM readings GROUP BY asset_id, time_bucket(INTERVAL {k} MINUTE, ts)""" for k in (2, 5, 10))))
def cadence_snapshot(spark, sf):
    r = T.readings(spark, sf)
    return W.cadence_snapshots(r, KEYS, (2, 5, 10))


@query("time_split", O.with_ctes(R, """
idx AS (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS gpos, count(*) OVER () AS n FROM readings)""",
                                 "folds AS (SELECT unnest([0, 1, 2]) AS fold)", body="""
SELECT fold, role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT f.fold, CASE WHEN gpos < n - (3 - f.fold) * (n // 4) THEN 'train' ELSE 'test' END AS role, ts
  FROM idx, folds f WHERE gpos < n - (2 - f.fold) * (n // 4)) x
GROUP BY ALL"""))
def time_split(spark, sf):
    return W.time_split_summary(T.readings(spark, sf), ORDER, 3)


@query("time_features", O.with_ctes(R, body="""
SELECT seq, year(ts) AS year, month(ts) AS month, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year,
  round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_cos,
  round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos,
  round(sin(2 * pi() * dayofyear(ts) / 365), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365), 6) AS doy_cos,
  hour(ts) // 8 AS shift FROM readings"""))
def time_features(spark, sf):
    r = T.readings(spark, sf)
    return r.select("seq", *r6(CAL.time_features("ts")))


_INTER = ["feed_pb", "kex", "sipx", "air_flow", "level"]


@query("interactions", O.with_ctes(R, FIN, body="SELECT seq, " + ", ".join(
    f"round({a} * {b}, 6) AS {a}_x_{b}" for i, a in enumerate(_INTER) for b in _INTER[i + 1:]) + " FROM fin"))
def interactions(spark, sf):
    return base(spark, sf).select("seq", *r6(CAL.interactions(_INTER)))


@query("polynomials", O.with_ctes(R, FIN, body="SELECT seq, " + ", ".join(
    f"round({c} * {c}, 6) AS {c}_squared, round({c} * {c} * {c}, 6) AS {c}_cubed" for c in _INTER[:3]) + " FROM fin"))
def polynomials(spark, sf):
    return base(spark, sf).select("seq", *r6(CAL.polynomials(_INTER[:3])))


def _irr_sql():
    parts = []
    for h in (5, 15, 30, 60):
        fr = (f"OVER (PARTITION BY asset_id ORDER BY ts RANGE BETWEEN INTERVAL {h} MINUTE FOLLOWING "
              f"AND INTERVAL {h + 30} MINUTE FOLLOWING)")
        parts.append(f"first_value(kex) {fr} AS kex_{h}min_ahead")
    return ", ".join(parts)


@query("horizon_targets_time", O.with_ctes(R, FIN, body=f"SELECT seq, {_irr_sql()} FROM fin"))
def horizon_targets_time(spark, sf):
    """W17 on irregular data: first value in [t + h, t + h + 30 min]."""
    out = H.time_windowed(base(spark, sf), KEYS, "ts", lambda w: W.irregular_targets(w, "kex", tol_minutes=30),
                          lookback_seconds=0, lookahead_seconds=90 * 60)
    return out.select("seq", *[f"kex_{h}min_ahead" for h in (5, 15, 30, 60)])
