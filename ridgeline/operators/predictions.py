"""Prediction analytics: as-of validation, accuracy, metrics, registry,
drift, trends, confidence and intervals (J3, J4, A7-A14, F17, F19, W24, M9).

Keyed by horizon, which has only four values: nothing here partitions a
window by horizon alone.  Per-horizon tails use ``row_number() <= k``
(WindowGroupLimit: at most k rows per horizon and partition are shuffled),
and totals are plain partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ridgeline.plans.halo import epoch_micros, fill_forward

# --- fixed values that must equal the reference's ---------------------------
DRIFT_THRESHOLD = 0.15          # relative change of mean that counts as drift
DRIFT_RECENT, DRIFT_MIN_OLDER = 10, 5
TREND_LAST = 20
CONFIDENCE_WEIGHTS = (0.3, 0.25, 0.25, 0.2)   # performance, agreement, width, history
AGREEMENT_SCORE = 0.9
INTERVAL_SIGMAS = 2.0           # prediction +- 2 * RMSE
HORIZON_WIDEN = {5: 1.0, 15: 2.0, 30: 3.0, 60: 5.0}   # target widening per horizon
# ---------------------------------------------------------------------------


def asof_attach(actuals: DataFrame, preds: DataFrame, keys: Sequence[str] = ("asset_id",),
                horizons: Sequence[int] = (5, 15, 30, 60)) -> DataFrame:
    """Each actual (keys, ts, actual) gets, per horizon, the latest
    prediction whose target time is at or before it.

    Union of both sides ordered by (keys, horizon, time, kind) and a chunked
    forward fill of the prediction fields (no per-key task, no range join).
    """
    hz = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    a = actuals.select(*keys, hz, F.col("ts").alias("_t"), F.lit(1).alias("_kind"), "ts", "actual",
                       F.lit(None).cast("double").alias("prediction"), F.lit(None).cast("timestamp_ntz").alias("pred_ts"),
                       F.lit(None).cast("double").alias("issue_value"))
    p = preds.select(*keys, "horizon", F.col("target_ts").alias("_t"), F.lit(0).alias("_kind"),
                     F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("actual"),
                     "prediction", F.col("ts").alias("pred_ts"), F.col("issue_value"))
    u = a.unionByName(p)
    filled = fill_forward(u, [*keys, "horizon"], ["_t", "_kind"], ["prediction", "pred_ts", "issue_value"])
    return filled.filter(F.col("_kind") == 1).drop("_t", "_kind")


def point_accuracy(actual: Column, pred: Column) -> list[Column]:
    """A14 per pair: absolute error, % error (0 when actual is 0), within 10 %,
    accuracy = max(0, 100 - % error)."""
    err = F.abs(actual - pred)
    pct = F.when(actual != 0, err / actual * 100.0).otherwise(F.lit(0.0))
    return [err.alias("abs_error"), pct.alias("pct_error"), (pct <= 10).alias("within_10"),
            F.greatest(F.lit(0.0), F.lit(100.0) - pct).alias("accuracy")]


def accuracy_parts(df: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "prediction") -> DataFrame:
    """A14 sums per key; those of several parts add up."""
    x = df.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull()).select(*keys, *point_accuracy(F.col(actual), F.col(pred)))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("abs_error").alias("abs_error"), F.sum("pct_error").alias("pct_error"),
                                F.sum(F.col("within_10").cast("long")).alias("within_10"), F.sum("accuracy").alias("accuracy"))


def merged_accuracy(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A14 from the ``accuracy_parts`` of all parts."""
    n = F.sum("n")
    return parts.groupBy(*keys).agg(n.alias("n"), (F.sum("abs_error") / n).alias("mae"), (F.sum("pct_error") / n).alias("mean_pct_error"),
                                    (F.sum("within_10") / n).alias("within_10_share"), (F.sum("accuracy") / n).alias("mean_accuracy"))


def accuracy_by(df: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "prediction") -> DataFrame:
    """A14 rolled up: mean errors, within-10 share and mean accuracy per key."""
    x = df.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull()).select(*keys, *point_accuracy(F.col(actual), F.col(pred)))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("abs_error").alias("mae"),
                                F.avg("pct_error").alias("mean_pct_error"),
                                F.avg(F.col("within_10").cast("double")).alias("within_10_share"),
                                F.avg("accuracy").alias("mean_accuracy"))


def due_pairs(preds: DataFrame, actuals: DataFrame, minutes: int = 5) -> DataFrame:
    """Each actual (asset_id, ts, actual) with the asset's predictions that fell
    due in the ``minutes`` before it: target_ts <= ts < target_ts + minutes.
    An interval join, for tables and for streams with watermarks alike.  Rows
    meet by asset and time bucket of that length: an actual lies in the bucket
    of target_ts or in the next one, so a row is compared with those of two
    buckets, never with all of its asset; an actual, of which there are fewer,
    goes to both."""
    wall = all(isinstance(d.schema[c].dataType, TimestampNTZType) for d, c in ((preds, "target_ts"), (actuals, "ts")))
    micros = epoch_micros if wall else (lambda c: F.unix_micros(F.col(c).cast("timestamp")))
    bucket = lambda c: F.floor(micros(c) / F.lit(minutes * 60_000_000))
    a = actuals.select(F.col("asset_id").alias("_asset"), F.col("ts").alias("actual_ts"), "actual", F.explode(F.array(bucket("ts"), bucket("ts") - 1)).alias("_in"))
    p = preds.withColumn("_bucket", bucket("target_ts"))
    due = ((F.col("asset_id") == F.col("_asset")) & (F.col("_bucket") == F.col("_in")) & (F.col("actual_ts") >= F.col("target_ts"))
           & (F.col("actual_ts") < F.col("target_ts") + F.expr(f"INTERVAL {minutes} MINUTES")))
    return p.join(a, due).drop("_asset", "_bucket", "_in")


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str = "actual", p: str = "prediction") -> DataFrame:
    """R2 = 1 - SSE / (n * var_pop(y)), RMSE, MAE, share with |e|/y <= 10 %.
    One aggregation; cross-checked against ``RegressionEvaluator`` in tests."""
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = F.col(y) - F.col(p)
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg((F.abs(e) / F.col(y) * 100.0 <= 10).cast("double")).alias("acc10"))


def model_registry(pairs: DataFrame) -> DataFrame:
    """Registry of candidate predictors evaluated on the as-of pairs: the
    logged prediction, persistence (value at issue time) and their blend."""
    models = F.explode(F.array(
        F.struct(F.lit("logged").alias("model"), F.col("prediction").alias("p")),
        F.struct(F.lit("persistence").alias("model"), F.col("issue_value").alias("p")),
        F.struct(F.lit("blend").alias("model"), ((F.col("prediction") + F.col("issue_value")) / 2.0).alias("p"))))
    long = pairs.select("horizon", "actual", models.alias("m")).select("horizon", "actual", "m.model", F.col("m.p").alias("prediction"))
    return regression_metrics(long, ["horizon", "model"])


def best_model(registry: DataFrame) -> DataFrame:
    """Best model per horizon by R2, ties to the smaller name."""
    # the registry has one row per (horizon, model): a tiny table
    w = Window.partitionBy("horizon").orderBy(F.col("r2").desc(), F.col("model"))
    return (registry.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
            .select("horizon", F.col("model").alias("best_model"), F.col("r2").alias("best_r2"),
                    F.col("rmse").alias("best_rmse")))


def model_compare(registry: DataFrame, baseline: str = "persistence") -> DataFrame:
    """Gain of every model over the baseline model of its horizon."""
    base = registry.filter(F.col("model") == baseline).select(
        "horizon", F.col("r2").alias("base_r2"), F.col("rmse").alias("base_rmse"))
    return (registry.join(base, "horizon")
            .select("horizon", "model", "r2", "rmse", (F.col("r2") - F.col("base_r2")).alias("r2_gain"),
                    F.when(F.col("base_rmse") != 0, (F.col("base_rmse") - F.col("rmse")) / F.col("base_rmse") * 100.0)
                     .alias("rmse_improvement_pct")))


def model_summary(registry: DataFrame) -> DataFrame:
    """A10: per horizon, models known, best by R2 and mean metrics."""
    return registry.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"),
        F.max_by("model", "r2").alias("best_model"), F.max("r2").alias("best_r2"),
        F.avg("rmse").alias("avg_rmse"), F.avg("acc10").alias("avg_acc10"))


def with_interval(preds: DataFrame, registry: DataFrame, model: str = "logged") -> DataFrame:
    """J4 + F19: attach the model's metrics (the planner broadcasts a registry
    that is small) and the interval prediction +- 2 RMSE."""
    m = registry.filter(F.col("model") == model).select("horizon", "r2", "rmse", "mae", "acc10")
    return (preds.join(m, "horizon", "left")
            .withColumn("lower", F.col("prediction") - INTERVAL_SIGMAS * F.col("rmse"))
            .withColumn("upper", F.col("prediction") + INTERVAL_SIGMAS * F.col("rmse")))


def _tail(preds: DataFrame, k: int, keys: Sequence[str], newest: bool = True) -> DataFrame:
    order = [F.col("ts").desc(), F.col("seq").desc()] if newest else [F.col("ts"), F.col("seq")]
    w = Window.partitionBy(*keys).orderBy(*order)
    return preds.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)


def _drift_table(j: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """A11 from n, s_all (sum of all), s_recent (of the newest 10) and m_first5."""
    recent_mean = F.col("s_recent") / DRIFT_RECENT
    older_mean = F.when(F.col("n") > DRIFT_RECENT, (F.col("s_all") - F.col("s_recent")) / (F.col("n") - DRIFT_RECENT)) \
                  .otherwise(F.col("m_first5"))
    change = F.when(older_mean != 0, F.abs(recent_mean - older_mean) / F.abs(older_mean)).otherwise(F.lit(0.0))
    enough = F.col("n") >= DRIFT_RECENT
    return j.select(*keys, "n",
                    F.when(enough, recent_mean).alias("recent_mean"), F.when(enough, older_mean).alias("older_mean"),
                    F.when(enough, change).alias("drift_pct"),
                    F.when(~enough, "insufficient").when(change > threshold, "drift").otherwise("stable").alias("drift_status"))


def prediction_drift(preds: DataFrame, keys: Sequence[str] = ("horizon",), threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Mean of the newest 10 predictions vs the older ones (the first 5
    when exactly 10 exist); relative change > threshold is drift; fewer than
    10 -> insufficient."""
    tot = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("s_all"))
    rec = _tail(preds, DRIFT_RECENT, keys).groupBy(*keys).agg(F.sum("prediction").alias("s_recent"))
    first = _tail(preds, DRIFT_MIN_OLDER, keys, newest=False).groupBy(*keys).agg(F.avg("prediction").alias("m_first5"))
    return _drift_table(tot.join(rec, list(keys)).join(first, list(keys)), keys, threshold)


def drift_parts(preds: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """What A11 needs of a part of the predictions: per key the count, the sum,
    and the newest 10 and oldest 5 rows.  Parts of a log merge into its drift
    table, so the log itself isn't read again."""
    row = F.collect_list(F.struct("ts", "seq", "prediction"))
    tot = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("s_all"))
    new = _tail(preds, DRIFT_RECENT, keys).groupBy(*keys).agg(row.alias("newest"))
    old = _tail(preds, DRIFT_MIN_OLDER, keys, newest=False).groupBy(*keys).agg(row.alias("oldest"))
    return tot.join(new, list(keys)).join(old, list(keys))


def merged_drift(parts: DataFrame, keys: Sequence[str] = ("horizon",), threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """A11 from the ``drift_parts`` of all parts of a log."""
    tot = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s_all").alias("s_all"))
    rows = lambda c: parts.select(*keys, F.inline(c))
    rec = _tail(rows("newest"), DRIFT_RECENT, keys).groupBy(*keys).agg(F.sum("prediction").alias("s_recent"))
    first = _tail(rows("oldest"), DRIFT_MIN_OLDER, keys, newest=False).groupBy(*keys).agg(F.avg("prediction").alias("m_first5"))
    return _drift_table(tot.join(rec, list(keys)).join(first, list(keys)), keys, threshold)


def recent_trends(preds: DataFrame, keys: Sequence[str] = ("horizon",), k: int = TREND_LAST) -> DataFrame:
    """Over the newest k predictions: mean, population std, min, max and
    direction (newest > oldest of the k -> increasing)."""
    t = _tail(preds, k, keys)
    return t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("std"),
        F.min("prediction").alias("min"), F.max("prediction").alias("max"),
        F.when(F.max_by("prediction", "_rk") < F.min_by("prediction", "_rk"), "increasing")
         .otherwise("decreasing").alias("direction"))


def confidence_score(latest: DataFrame, accuracy: DataFrame) -> DataFrame:
    """0.3 * min(r2, 1) + 0.25 * 0.9 + 0.25 * (1 - min(ci width / |p|, 1))
    + 0.2 * historical within-10 share (0.5 without validations), clamp 0-1."""
    wp, wa, ww, wh = CONFIDENCE_WEIGHTS
    j = latest.join(accuracy.select("horizon", "within_10_share"), "horizon", "left")
    width = F.when(F.col("prediction") != 0,
                   F.lit(1.0) - F.least(F.lit(1.0), (F.col("upper") - F.col("lower")) / F.abs(F.col("prediction")))
                   ).otherwise(F.lit(0.5))
    hist = F.coalesce(F.col("within_10_share"), F.lit(0.5))
    score = wp * F.least(F.col("r2"), F.lit(1.0)) + wa * AGREEMENT_SCORE + ww * width + wh * hist
    return j.select("horizon", "prediction", "r2", width.alias("width_score"), hist.alias("historical_score"),
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))


def horizon_state(pred: Column, horizon: Column, lo: float = 15.0, hi: float = 35.0) -> Column:
    """target band widened by horizon; below_min / above_max (>= max) / good."""
    widen = F.lit(0.0)
    for h, d in HORIZON_WIDEN.items():
        widen = F.when(horizon == h, F.lit(d)).otherwise(widen)
    mn = F.greatest(F.lit(0.0), F.lit(lo) - widen)
    mx = F.lit(hi) + widen
    return F.when(pred < mn, "below_min").when(pred >= mx, "above_max").otherwise("good")


def trend_direction(pred: Column, current: Column) -> Column:
    """up / down / stable of a prediction against the current value."""
    return F.when(pred > current, "up").when(pred < current, "down").otherwise("stable")
