"""Queries for prediction analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.operators import predictions as PR
from ridgeline.operators import windows as W
from ridgeline.plans import halo as H
from ridgeline.plans import oracle as O
from ridgeline.plans.q_clean import CALC, PREDS
from ridgeline.plans.registry import query
from ridgeline.sources import tables as T

R = O.READINGS


def r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pairs(spark, sf):
    r = T.readings(spark, sf)
    return PR.asof_attach(T.actuals(r), T.preds(r))


def _registry(spark, sf):
    return PR.model_registry(_pairs(spark, sf).filter(F.col("prediction").isNotNull()))


PAIRS = """
pairs AS (
  SELECT a.asset_id, a.horizon, a.ts, a.actual, p.prediction, p.ts AS pred_ts, p.issue_value
  FROM (SELECT c.asset_id, h.horizon, c.ts, c.grade AS actual FROM calc c, (SELECT unnest([5, 15, 30, 60]) AS horizon) h) a
  ASOF LEFT JOIN preds p ON a.asset_id = p.asset_id AND a.horizon = p.horizon AND a.ts >= p.target_ts)"""
ACC = """abs(actual - prediction) AS abs_error,
  CASE WHEN actual <> 0 THEN abs(actual - prediction) / actual * 100.0 ELSE 0.0 END AS pct_error"""
REG = """
reg AS (
  SELECT horizon, model, count(*) AS n,
         1.0 - sum((actual - p) * (actual - p)) / nullif(var_pop(actual) * count(*), 0) AS r2,
         sqrt(avg((actual - p) * (actual - p))) AS rmse, avg(abs(actual - p)) AS mae,
         avg(CAST(abs(actual - p) / actual * 100.0 <= 10 AS DOUBLE)) AS acc10
  FROM (SELECT horizon, actual, 'logged' AS model, prediction AS p FROM pairs WHERE prediction IS NOT NULL
        UNION ALL SELECT horizon, actual, 'persistence', issue_value FROM pairs WHERE prediction IS NOT NULL
        UNION ALL SELECT horizon, actual, 'blend', (prediction + issue_value) / 2.0 FROM pairs WHERE prediction IS NOT NULL) x
  GROUP BY horizon, model)"""
BASE = (R, CALC, PREDS, PAIRS)


def rsel(cols):
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)


@query("asof_validate", O.with_ctes(*BASE, body=f"""
SELECT asset_id, horizon, ts, pred_ts, {rsel(['actual', 'prediction', 'issue_value'])},
       round(abs(actual - prediction), 6) AS abs_error,
       round(CASE WHEN actual <> 0 THEN abs(actual - prediction) / actual * 100.0 ELSE 0.0 END, 6) AS pct_error,
       coalesce(CASE WHEN actual <> 0 THEN abs(actual - prediction) / actual * 100.0 ELSE 0.0 END <= 10, false) AS within_10
FROM pairs"""))
def asof_validate(spark, sf):
    p = _pairs(spark, sf)
    acc = PR.point_accuracy(F.col("actual"), F.col("prediction"))
    return r6(p.select("asset_id", "horizon", "ts", "pred_ts", "actual", "prediction", "issue_value", *acc[:2],
                       F.coalesce(acc[2], F.lit(False)).alias("within_10")))


@query("pred_accuracy", O.with_ctes(*BASE, body=f"""
SELECT horizon, count(*) AS n, round(avg(abs_error), 6) AS mae, round(avg(pct_error), 6) AS mean_pct_error,
       round(avg(CAST(pct_error <= 10 AS DOUBLE)), 6) AS within_10_share,
       round(avg(greatest(0.0, 100.0 - pct_error)), 6) AS mean_accuracy
FROM (SELECT horizon, {ACC} FROM pairs WHERE prediction IS NOT NULL) x GROUP BY horizon"""))
def pred_accuracy(spark, sf):
    return r6(PR.accuracy_by(_pairs(spark, sf), ["horizon"]))


@query("reg_metrics", O.with_ctes(*BASE, REG, body=f"SELECT horizon, n, {rsel(['r2', 'rmse', 'mae', 'acc10'])} FROM reg WHERE model = 'logged'"))
def reg_metrics(spark, sf):
    m = PR.regression_metrics(_pairs(spark, sf), ["horizon"])
    return r6(m)


@query("model_registry", O.with_ctes(*BASE, REG, body=f"SELECT horizon, model, n, {rsel(['r2', 'rmse', 'mae', 'acc10'])} FROM reg"))
def model_registry(spark, sf):
    return r6(_registry(spark, sf))


@query("best_model", O.with_ctes(*BASE, REG, body="""
SELECT horizon, model AS best_model, round(r2, 6) AS best_r2, round(rmse, 6) AS best_rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY r2 DESC, model) AS rk FROM reg) WHERE rk = 1"""))
def best_model(spark, sf):
    return r6(PR.best_model(_registry(spark, sf)))


@query("model_compare", O.with_ctes(*BASE, REG, body="""
SELECT r.horizon, r.model, round(r.r2, 6) AS r2, round(r.rmse, 6) AS rmse, round(r.r2 - b.r2, 6) AS r2_gain,
       round(CASE WHEN b.rmse <> 0 THEN (b.rmse - r.rmse) / b.rmse * 100.0 END, 6) AS rmse_improvement_pct
FROM reg r JOIN (SELECT * FROM reg WHERE model = 'persistence') b USING (horizon)"""))
def model_compare(spark, sf):
    return r6(PR.model_compare(_registry(spark, sf)))


@query("model_summary", O.with_ctes(*BASE, REG, body="""
SELECT horizon, count(*) AS n_models, string_agg(model, ',' ORDER BY model) AS models, arg_max(model, r2) AS best_model,
       round(max(r2), 6) AS best_r2, round(avg(rmse), 6) AS avg_rmse, round(avg(acc10), 6) AS avg_acc10
FROM reg GROUP BY horizon"""))
def model_summary(spark, sf):
    return r6(PR.model_summary(_registry(spark, sf)))


@query("score_with_metrics", O.with_ctes(*BASE, REG, body="""
SELECT p.seq, p.horizon, round(p.prediction, 6) AS prediction, round(r.r2, 6) AS r2, round(r.rmse, 6) AS rmse,
       round(p.prediction - 2.0 * r.rmse, 6) AS lower, round(p.prediction + 2.0 * r.rmse, 6) AS upper
FROM preds p LEFT JOIN (SELECT * FROM reg WHERE model = 'logged') r USING (horizon)"""))
def score_with_metrics(spark, sf):
    r = T.readings(spark, sf)
    s = PR.with_interval(T.preds(r), _registry(spark, sf))
    return r6(s.select("seq", "horizon", "prediction", "r2", "rmse", "lower", "upper"))


@query("prediction_drift", O.with_ctes(R, CALC, PREDS, """
rk AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ts DESC, seq DESC) AS rd,
              row_number() OVER (PARTITION BY horizon ORDER BY ts, seq) AS ra, count(*) OVER (PARTITION BY horizon) AS n FROM preds)""", """
m AS (SELECT horizon, any_value(n) AS n, avg(prediction) FILTER (WHERE rd <= 10) AS recent_mean,
             CASE WHEN any_value(n) > 10 THEN avg(prediction) FILTER (WHERE rd > 10) ELSE avg(prediction) FILTER (WHERE ra <= 5) END AS older_mean
      FROM rk GROUP BY horizon)""", body="""
SELECT horizon, n, round(CASE WHEN n >= 10 THEN recent_mean END, 6) AS recent_mean, round(CASE WHEN n >= 10 THEN older_mean END, 6) AS older_mean,
       round(CASE WHEN n >= 10 THEN (CASE WHEN older_mean <> 0 THEN abs(recent_mean - older_mean) / abs(older_mean) ELSE 0.0 END) END, 6) AS drift_pct,
       CASE WHEN n < 10 THEN 'insufficient'
            WHEN (CASE WHEN older_mean <> 0 THEN abs(recent_mean - older_mean) / abs(older_mean) ELSE 0.0 END) > 0.15 THEN 'drift'
            ELSE 'stable' END AS drift_status
FROM m"""))
def prediction_drift(spark, sf):
    return r6(PR.prediction_drift(T.preds(T.readings(spark, sf))))


@query("prediction_drift_asset", O.with_ctes(R, CALC, PREDS, """
rk AS (SELECT *, row_number() OVER (PARTITION BY asset_id, horizon ORDER BY ts DESC, seq DESC) AS rd,
              row_number() OVER (PARTITION BY asset_id, horizon ORDER BY ts, seq) AS ra,
              count(*) OVER (PARTITION BY asset_id, horizon) AS n FROM preds)""", """
m AS (SELECT asset_id, horizon, any_value(n) AS n, avg(prediction) FILTER (WHERE rd <= 10) AS recent_mean,
             CASE WHEN any_value(n) > 10 THEN avg(prediction) FILTER (WHERE rd > 10) ELSE avg(prediction) FILTER (WHERE ra <= 5) END AS older_mean
      FROM rk GROUP BY asset_id, horizon)""", body="""
SELECT asset_id, horizon, n, round(CASE WHEN n >= 10 THEN recent_mean END, 6) AS recent_mean,
       round(CASE WHEN n >= 10 THEN older_mean END, 6) AS older_mean,
       round(CASE WHEN n >= 10 THEN (CASE WHEN older_mean <> 0 THEN abs(recent_mean - older_mean) / abs(older_mean) ELSE 0.0 END) END, 6) AS drift_pct,
       CASE WHEN n < 10 THEN 'insufficient'
            WHEN (CASE WHEN older_mean <> 0 THEN abs(recent_mean - older_mean) / abs(older_mean) ELSE 0.0 END) > 0.15 THEN 'drift'
            ELSE 'stable' END AS drift_status
FROM m"""))
def prediction_drift_asset(spark, sf):
    """A11 per asset and horizon."""
    p = T.preds(T.readings(spark, sf))
    return r6(PR.prediction_drift(p, ["asset_id", "horizon"]))


@query("recent_trends", O.with_ctes(R, CALC, PREDS, """
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ts DESC, seq DESC) AS rk FROM preds) WHERE rk <= 20)""", body="""
SELECT horizon, count(*) AS n, round(avg(prediction), 6) AS mean, round(stddev_pop(prediction), 6) AS std,
       round(min(prediction), 6) AS min, round(max(prediction), 6) AS max,
       CASE WHEN arg_max(prediction, rk) < arg_min(prediction, rk) THEN 'increasing' ELSE 'decreasing' END AS direction
FROM t GROUP BY horizon"""))
def recent_trends(spark, sf):
    return r6(PR.recent_trends(T.preds(T.readings(spark, sf))))


@query("confidence_score", O.with_ctes(*BASE, REG, """
lp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ts DESC, seq DESC) AS rk FROM preds) WHERE rk = 1)""", """
iv AS (SELECT lp.horizon, lp.prediction, r.r2, lp.prediction - 2.0 * r.rmse AS lower, lp.prediction + 2.0 * r.rmse AS upper
       FROM lp LEFT JOIN (SELECT * FROM reg WHERE model = 'logged') r USING (horizon))""", f"""
acc AS (SELECT horizon, avg(CAST(pct_error <= 10 AS DOUBLE)) AS within_10_share
        FROM (SELECT horizon, {ACC} FROM pairs WHERE prediction IS NOT NULL) x GROUP BY horizon)""", """
sc AS (SELECT iv.horizon, iv.prediction, iv.r2,
              CASE WHEN prediction <> 0 THEN 1.0 - least(1.0, (upper - lower) / abs(prediction)) ELSE 0.5 END AS width_score,
              coalesce(within_10_share, 0.5) AS historical_score FROM iv LEFT JOIN acc USING (horizon))""", body="""
SELECT horizon, round(prediction, 6) AS prediction, round(r2, 6) AS r2, round(width_score, 6) AS width_score,
       round(historical_score, 6) AS historical_score,
       round(greatest(0.0, least(1.0, 0.3 * least(r2, 1.0) + 0.25 * 0.9 + 0.25 * width_score + 0.2 * historical_score)), 6) AS confidence
FROM sc"""))
def confidence_score(spark, sf):
    r = T.readings(spark, sf)
    reg = _registry(spark, sf)
    pr = T.preds(r)
    latest = PR._tail(pr, 1, ["horizon"]).drop("_rk")
    latest = PR.with_interval(latest, reg)
    acc = PR.accuracy_by(_pairs(spark, sf), ["horizon"])
    return r6(PR.confidence_score(latest, acc))


@query("horizon_state", O.with_ctes(R, CALC, PREDS, body="""
SELECT seq, horizon,
  CASE WHEN prediction < greatest(0.0, 15.0 - CASE horizon WHEN 5 THEN 1.0 WHEN 15 THEN 2.0 WHEN 30 THEN 3.0 WHEN 60 THEN 5.0 ELSE 0.0 END) THEN 'below_min'
       WHEN prediction >= 35.0 + CASE horizon WHEN 5 THEN 1.0 WHEN 15 THEN 2.0 WHEN 30 THEN 3.0 WHEN 60 THEN 5.0 ELSE 0.0 END THEN 'above_max'
       ELSE 'good' END AS state,
  CASE WHEN prediction > issue_value THEN 'up' WHEN prediction < issue_value THEN 'down' ELSE 'stable' END AS trend
FROM preds"""))
def horizon_state(spark, sf):
    p = T.preds(T.readings(spark, sf))
    return p.select("seq", "horizon", PR.horizon_state(F.col("prediction"), F.col("horizon")).alias("state"),
                    PR.trend_direction(F.col("prediction"), F.col("issue_value")).alias("trend"))


@query("prev_cycle_acc", O.with_ctes(R, CALC, PREDS, """
x AS (SELECT seq, horizon, issue_value AS actual,
             lag(prediction) OVER (PARTITION BY asset_id, horizon ORDER BY ts, seq) AS prev_prediction FROM preds)""", body="""
SELECT seq, horizon, round(prev_prediction, 6) AS prev_prediction, round(abs(actual - prev_prediction), 6) AS abs_error,
       round(CASE WHEN actual <> 0 THEN abs(actual - prev_prediction) / actual * 100.0 ELSE 0.0 END, 6) AS pct_error
FROM x"""))
def prev_cycle_acc(spark, sf):
    p = T.preds(T.readings(spark, sf))
    out = H.row_windowed(p, ["asset_id", "horizon"], ["ts", "seq"],
                         lambda w: [F.lag("prediction", 1).over(w).alias("prev_prediction")], 1)
    acc = PR.point_accuracy(F.col("issue_value"), F.col("prev_prediction"))
    return r6(out.select("seq", "horizon", "prev_prediction", *acc[:2]))


@query("residuals", O.with_ctes(*BASE, body="""
SELECT asset_id, horizon, ts, round(actual, 6) AS actual, round(prediction, 6) AS predicted, round(actual - prediction, 6) AS residual
FROM pairs WHERE prediction IS NOT NULL"""))
def residuals(spark, sf):
    p = _pairs(spark, sf).filter(F.col("prediction").isNotNull())
    return r6(p.select("asset_id", "horizon", "ts", "actual", F.col("prediction").alias("predicted"),
                       (F.col("actual") - F.col("prediction")).alias("residual")))


_ = W  # windows builders are used through halo in other modules
