"""Ordered window features (W1-W24) as Column builders.

Each builder takes the ordered ``WindowSpec`` to use and returns named
Columns, so all features of one pass share ONE exchange + sort + Window
operator.  The spec comes from ``ridgeline.plans.halo`` (chunked per key, no
hot task) or, for small inputs, ``Window.partitionBy(key).orderBy(ts, seq)``.
Features whose frames are shifted (rolling over a lag, second differences)
are expanded algebraically onto the base column so they need no second
window stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLL_ROWS = 6  # 30 minutes of 5-minute rows


def _frame(w, lo: int, hi: int = 0):
    return w.rowsBetween(lo, hi)


class RangeFrames:
    """Stands for the window of ``halo.time_windowed``: notes the range frames
    that builders ask for, as (function, column, from, to) in microseconds
    around a row's time; each becomes a column of its own."""

    def __init__(self):
        self.asked: dict[tuple, str] = {}

    def over(self, fn: str, c: str | None, lo: int, hi: int) -> Column:
        return F.col(self.asked.setdefault((fn, c, lo, hi), f"_frame{len(self.asked)}"))


def _over_range(w_us, fn: str, c: str | None, lo: int, hi: int) -> Column:
    """count, first or last of the rows whose time lies in [t + lo, t + hi]."""
    if isinstance(w_us, RangeFrames):
        return w_us.over(fn, c, lo, hi)
    of = {"count": lambda: F.count(F.lit(1)), "first": lambda: F.first(c), "last": lambda: F.last(c)}[fn]()
    return of.over(w_us.rangeBetween(lo, hi))


def lag_rows(w, cols: Sequence[str], lags: Sequence[int] = (1, 2, 3, 4, 5)) -> list[Column]:
    """``{c}_lag_{k}``."""
    return [F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in cols for k in lags]


def lag_pair(w, cols: Sequence[str]) -> list[Column]:
    """lag1/lag2 falling back to the current value."""
    return [F.coalesce(F.lag(c, k).over(w), F.col(c)).alias(f"{c}_lag{k}") for c in cols for k in (1, 2)]


def lag_minutes(w, cols: Sequence[str], minutes: Sequence[int] = (5, 15, 30, 60), step_minutes: int = 1,
                means: dict[str, Column] | None = None) -> list[Column]:
    """``{c}_lag{m}min`` = value m minutes (m/step rows) back; missing ->
    the column mean (``means[c]``, e.g. a broadcast per-key mean)."""
    out = []
    for c in cols:
        for m in minutes:
            v = F.lag(c, m // step_minutes).over(w)
            if means is not None:
                v = F.coalesce(v, means[c])
            out.append(v.alias(f"{c}_lag{m}min"))
    return out


def lag_ratio(w, cols: Sequence[str], minutes: Sequence[int] = (5, 15, 30, 60), step_minutes: int = 1,
              means: dict[str, Column] | None = None) -> list[Column]:
    """``{c}_ratio_lag{m}min`` = c / lag, a zero lag counts as 1."""
    out = []
    for c in cols:
        for m in minutes:
            lagv = F.lag(c, m // step_minutes).over(w)
            if means is not None:
                lagv = F.coalesce(lagv, means[c])
            out.append((F.col(c) / F.when(lagv == 0, F.lit(1.0)).otherwise(lagv)).alias(f"{c}_ratio_lag{m}min"))
    return out


def rolling_basic(w, cols: Sequence[str], rows: int = ROLL_ROWS, suffix: str = "30min") -> list[Column]:
    """Rolling mean / sample std / min / max over ``rows`` rows (one row
    is enough; std of one value is null)."""
    fr = _frame(w, -(rows - 1), 0)
    out = []
    for c in cols:
        out += [F.avg(c).over(fr).alias(f"{c}_roll_mean_{suffix}"),
                F.stddev_samp(c).over(fr).alias(f"{c}_roll_std_{suffix}"),
                F.min(c).over(fr).alias(f"{c}_roll_min_{suffix}"),
                F.max(c).over(fr).alias(f"{c}_roll_max_{suffix}")]
    return out


def rolling_of_lag(w, cols: Sequence[str], lag: int, rows: int, suffix: str = "30min") -> list[Column]:
    """Rolling stats of ``lag(c, lag)`` without materialising the lag:
    the frame is shifted by ``lag`` rows on the base column."""
    fr = _frame(w, -(rows - 1) - lag, -lag)
    out = []
    for c in cols:
        name = f"{c}_lag{lag}"
        out += [F.avg(c).over(fr).alias(f"{name}_roll_mean_{suffix}"),
                F.stddev_samp(c).over(fr).alias(f"{name}_roll_std_{suffix}"),
                F.min(c).over(fr).alias(f"{name}_roll_min_{suffix}"),
                F.max(c).over(fr).alias(f"{name}_roll_max_{suffix}")]
    return out


def rolling_multi(w, cols: Sequence[str], windows: Sequence[int] = (5, 15, 30),
                  means: dict[str, Column] | None = None) -> list[Column]:
    """``{c}_rolling_{mean,std}_{n}min`` for several row counts, nulls ->
    column mean when ``means`` is given."""
    out = []
    for c in cols:
        for n in windows:
            fr = _frame(w, -(n - 1), 0)
            for stat, fn in (("mean", F.avg), ("std", F.stddev_samp)):
                v = fn(c).over(fr)
                if means is not None:
                    v = F.coalesce(v, means[c])
                out.append(v.alias(f"{c}_rolling_{stat}_{n}min"))
    return out


def rate_of_change(w, cols: Sequence[str], fill_zero: bool = False) -> list[Column]:
    """First difference."""
    out = []
    for c in cols:
        v = F.col(c) - F.lag(c, 1).over(w)
        out.append((F.coalesce(v, F.lit(0.0)) if fill_zero else v).alias(f"{c}_rate_of_change"))
    return out


def acceleration(w, cols: Sequence[str], fill_zero: bool = False) -> list[Column]:
    """Second difference, expanded to c - 2 lag1 + lag2 (one window)."""
    out = []
    for c in cols:
        v = F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
        out.append((F.coalesce(v, F.lit(0.0)) if fill_zero else v).alias(f"{c}_acceleration"))
    return out


def momentum(w, cols: Sequence[str], rows: int = 5) -> list[Column]:
    """C - lag(c, 5), missing -> 0."""
    return [F.coalesce(F.col(c) - F.lag(c, rows).over(w), F.lit(0.0)).alias(f"{c}_momentum_5min") for c in cols]


def rolling_zscore(w, cols: Sequence[str], rows: int = ROLL_ROWS, suffix: str = "30min") -> list[Column]:
    """(c - rolling mean) / rolling sample std; 0/0 and +-inf -> null."""
    fr = _frame(w, -(rows - 1), 0)
    return [((F.col(c) - F.avg(c).over(fr)) / F.nullif(F.stddev_samp(c).over(fr), F.lit(0.0)))
            .alias(f"{c}_zscore_{suffix}") for c in cols]


def rolling_quantiles(w, cols: Sequence[str], probs=(0.25, 0.75), rows: int = ROLL_ROWS,
                      suffix: str = "30min") -> list[Column]:
    """Exact rolling percentiles with linear interpolation (``percentile``
    keeps the frame's values: only for short frames)."""
    fr = _frame(w, -(rows - 1), 0)
    return [F.percentile(c, p).over(fr).alias(f"{c}_p{int(round(p * 100))}_{suffix}") for c in cols for p in probs]


def rolling_shape(w, cols: Sequence[str], rows: int = ROLL_ROWS, suffix: str = "30min") -> list[Column]:
    """Bias-corrected rolling skew (n >= 3) and excess kurtosis (n >= 4),
    as pandas; Spark's moments are the biased ones, corrected here."""
    fr = _frame(w, -(rows - 1), 0)
    out = []
    for c in cols:
        n = F.count(c).over(fr).cast("double")
        sd = F.stddev_pop(c).over(fr)
        g1 = F.skewness(c).over(fr)
        g2 = F.kurtosis(c).over(fr)
        ok = sd > 0
        skew = F.when((n >= 3) & ok, F.sqrt(n * (n - 1)) / (n - 2) * g1)
        kurt = F.when((n >= 4) & ok, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        out += [skew.alias(f"{c}_skew_{suffix}"), kurt.alias(f"{c}_kurt_{suffix}")]
    return out


def fill_gaps(w, cols: Sequence[str], order: str = "forward", zero: bool = False) -> list[Column]:
    """Forward fill (causal default), 'forward_backward' or 'backward_forward'.

    Needs unbounded frames: use with a per-key spec, or ``halo.fill_forward``
    for the chunked plan."""
    fwd_w = w.rowsBetween(Window.unboundedPreceding, 0)
    bwd_w = w.rowsBetween(0, Window.unboundedFollowing)
    out = []
    for c in cols:
        f = F.last(c, ignorenulls=True).over(fwd_w)
        b = F.first(c, ignorenulls=True).over(bwd_w)
        if order == "forward":
            v = f
        elif order == "forward_backward":
            v = F.coalesce(f, b)
        else:
            v = F.coalesce(b, f)
        if zero:
            v = F.coalesce(v, F.lit(0.0))
        out.append(v.alias(c))
    return out


def moving_average_full(w, c: str, n: int = 10) -> list[Column]:
    """Mean of the last n non-null values, only where the window is full
    (apply on rows with ``c`` not null)."""
    fr = _frame(w, -(n - 1), 0)
    return [F.when(F.count(c).over(fr) == n, F.avg(c).over(fr)).alias(f"{c}_ma{n}")]


def horizon_targets(w, c: str, horizons: Sequence[int] = (5, 15, 30, 60), step_minutes: int = 5,
                    name: str | None = None) -> list[Column]:
    """W17 (regular grid): value h minutes ahead = lead(c, h/step)."""
    name = name or c
    return [F.lead(c, max(1, h // step_minutes)).over(w).alias(f"{name}_{h}min_ahead") for h in horizons]


def external_change(w, c: str = "feed_pb", threshold: float = 0.1) -> list[Column]:
    """|c - previous c| > threshold (first row: no change)."""
    return [F.coalesce(F.abs(F.col(c) - F.lag(c, 1).over(w)) > threshold, F.lit(False)).alias("external_change")]


def time_lags(w_us, cols: Sequence[str], minutes: Sequence[int] = (5, 15, 30, 60),
              latest_minutes: Sequence[int] = (5,), few_history: Column | None = None) -> list[Column]:
    """From the history strictly before the row, the latest value within
    5 minutes and the oldest value within 15/30/60 minutes; empty range or
    too little history (``few_history``) -> current value.  ``w_us`` orders by
    microsecond epoch so range frames are in microseconds."""
    out = []
    for c in cols:
        for m in minutes:
            v = _over_range(w_us, "last" if m in latest_minutes else "first", c, -m * 60_000_000, -1)
            v = F.coalesce(v, F.col(c))
            if few_history is not None:
                v = F.when(few_history, F.col(c)).otherwise(v)
            out.append(v.alias(f"{c}_lag{m}min"))
    return out


def irregular_targets(w_us, c: str, horizons: Sequence[int] = (5, 15, 30, 60), tol_minutes: int = 5) -> list[Column]:
    """W17 (irregular data): first value in [t + h, t + h + tol] minutes."""
    return [_over_range(w_us, "first", c, h * 60_000_000, (h + tol_minutes) * 60_000_000)
            .alias(f"{c}_{h}min_ahead") for h in horizons]


def burst_count(w_us, seconds: int = 60, threshold: int = 300) -> list[Column]:
    """Rows of the key in the trailing ``seconds`` (inclusive) and breach flag."""
    n = _over_range(w_us, "count", None, -seconds * 1_000_000, 0)
    return [n.alias("n_window"), (n >= threshold).alias("breach")]


def keep_last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 100) -> DataFrame:
    """Last n rows per key.  ``row_number() <= n`` becomes a
    WindowGroupLimit, so only n rows per key and partition are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_n_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 10,
                  id_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """Per key, the ids of its first n rows (WindowGroupLimit: bounded shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.select(*keys, *id_cols, F.row_number().over(w).alias("_rn"))
              .filter(F.col("_rn") <= n).drop("_rn"))


def cadence_snapshots(df: DataFrame, keys: Sequence[str], cadences: Sequence[int] = (2, 5, 10),
                      ts: str = "ts", tie: str = "seq") -> DataFrame:
    """First point of each aligned k-minute window per key, for several
    cadences (hash aggregate with ``min_by``; no sort)."""
    parts = []
    for k in cadences:
        win = F.window(ts, f"{k} minutes")
        parts.append(df.groupBy(*keys, win.start.alias("window_start"))
                       .agg(F.min_by(F.col(tie), F.struct(F.col(ts), F.col(tie))).alias(tie),
                            F.count(F.lit(1)).alias("n_points"))
                       .select(F.lit(k).alias("cadence_minutes"), *keys, "window_start", tie, "n_points"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_split(df: DataFrame, order: Sequence[str], folds: int = 3) -> DataFrame:
    """Expanding-window folds over the global time order.

    Adds ``fold`` and ``role`` ('train' / 'test'): with n rows and
    ``size = n // (folds + 1)``, the last ``folds * size`` rows are tested,
    ``size`` in each fold, and a fold trains on everything before its test
    block: the first train block takes the remainder, no row is left out.
    A row appears once per fold that uses it.  Positions come from the
    range-partitioned global index (no single-task sort)."""
    from ridgeline.plans.halo import global_positions
    pos = global_positions(df, [], order)
    n = pos.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    ts_size = n // (folds + 1)
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    x = pos.withColumn("fold", fold)
    start = F.lit(n - folds * ts_size) + F.col("fold") * ts_size
    x = x.filter(F.col("_gpos") < start + ts_size)
    role = F.when(F.col("_gpos") < start, "train").otherwise("test")
    return x.withColumn("role", role).drop("_gpos")


def time_split_summary(df: DataFrame, order: Sequence[str], folds: int = 3, ts: str = "ts") -> DataFrame:
    s = time_split(df, order, folds)
    return s.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"),
                                         F.max(ts).alias("last_ts"))
