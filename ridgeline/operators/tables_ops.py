"""Table-level summaries, top-k, sampling and set operations
(A2, A4-A6, T1, T2, T5-T7, U1-U3)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.process import round_half_up

# --- fixed values that must equal the reference's ---------------------------
# Save cadence (minutes) of the three snapshot tables.
CADENCE_MINUTES = {"sensor": 2, "calculated": 5, "optimization": 10}
# Preset look-back ranges.
PRESETS = {"1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}
# ---------------------------------------------------------------------------


def target_profile(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """A2: mean, sample std, min, max and null count of the target."""
    g = df.groupBy(*keys) if keys else df
    return g.agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"),
                 F.min(target).alias("min"), F.max(target).alias("max"),
                 F.count_if(F.col(target).isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"))


def table_stats(tables: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """A4: rows and time span per table, one small row each (partial aggs)."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                    F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def latest_record(tables: dict[str, DataFrame], ts: str = "ts", tie: str = "seq") -> DataFrame:
    """A5: newest record of every table (max_by: no sort, one partial agg)."""
    parts = [df.agg(F.lit(name).alias("table_name"),
                    F.max_by(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("seq")),
                             F.struct(F.col(ts), F.col(tie))).alias("r"))
               .select("table_name", "r.ts", "r.seq")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def freshness(tables: dict[str, DataFrame], as_of: Column, cadence: dict[str, int] = CADENCE_MINUTES,
              ts: str = "ts") -> DataFrame:
    """Minutes since the last row, minutes until the next save, ready flag."""
    parts = []
    for name, df in tables.items():
        last = df.agg(F.max(ts).alias("last_ts"))
        since = (F.timestamp_diff("MICROSECOND", F.col("last_ts"), as_of) / 60_000_000.0)
        parts.append(last.select(
            F.lit(name).alias("table_name"), F.lit(cadence[name]).cast("bigint").alias("interval_minutes"),
            "last_ts", round_half_up(since, 2).alias("minutes_since_last_save"),
            round_half_up(F.greatest(F.lit(0.0), F.lit(float(cadence[name])) - since), 2)
            .alias("minutes_until_next_save"),
            (since >= cadence[name]).alias("ready_to_save")))
    return reduce(DataFrame.unionByName, parts)


def latest_n(df: DataFrame, n: int = 100, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Newest n rows (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def latest_in_range(df: DataFrame, start=None, end=None, n: int = 100, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """P7 optional range then T1."""
    from ridgeline.operators.clean import range_optional
    return latest_n(range_optional(df, start, end, ts), n, ts, tie)


def preset_range(df: DataFrame, preset: str = "24h", ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Rows within a preset span before the newest timestamp (per key)."""
    interval = F.expr(f"INTERVAL {PRESETS[preset]}")
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last")) if keys else df.agg(F.max(ts).alias("_last"))
    # one row per key: AQE broadcasts it when it is small, else a regular join
    j = df.join(last, list(keys)) if keys else df.join(F.broadcast(last.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")
    return j.filter(F.col(ts) >= F.col("_last") - interval).drop("_last")


_H52 = (1 << 52) - 1


def _hash52(key: Sequence[str], seed: int) -> Column:
    """Seeded 52-bit hash (exact as a double, so order statistics are exact)."""
    return F.xxhash64(*[F.col(c) for c in key], F.lit(seed)).bitwiseAND(F.lit(_H52)).cast("double")


def sample_n(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] = ("seq",)) -> DataFrame:
    """T5: repeatable sample of min(n, rows) rows without replacement: the
    rows with the n smallest seeded hashes.

    The cut-off is the exact n-th smallest hash (histogram refinement, no
    single-task gather of n rows per partition); rows tied on the cut-off
    hash are taken in key order."""
    from ridgeline.operators.quantiles import column_profile, exact_order_stats
    d = df.withColumn("_h", _hash52(key, seed))
    prof = column_profile(d, ["_h"])
    total = prof["_h"][0]
    if total <= n:
        return d.drop("_h")
    t = exact_order_stats(d, {"_h": [n - 1]}, prof)["_h"][n - 1]
    below = d.filter(F.col("_h") < t)
    need = n - below.count()
    ties = d.filter(F.col("_h") == t).orderBy(*key).limit(need)
    return below.unionByName(ties).drop("_h")


def sample_stratified(df: DataFrame, bin_col: str, frac: float, seed: int = 42,
                      key: Sequence[str] = ("seq",)) -> DataFrame:
    """Per bin keep round(frac * bin size) rows with the smallest hashes.

    Bin sizes come from one small aggregate; the per-bin cut-offs are exact
    order statistics of per-bin hash columns (one refinement search for all
    bins), so no bin is ranked inside a single task.  Of the rows that share
    a bin's cut-off hash, as many are kept, in key order, as are missing."""
    from ridgeline.operators.quantiles import column_profile, exact_order_stats
    d = df.withColumn("_h", _hash52(key, seed))
    sizes = {r[bin_col]: r["n"] for r in d.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n")).collect()}  # <= bins
    keep = {b: _round_half_up(n * frac) for b, n in sizes.items()}
    cols = {b: f"_h_{i}" for i, b in enumerate(sorted(sizes))}
    dd = d.select("*", *[F.when(F.col(bin_col) == b, F.col("_h")).alias(c) for b, c in cols.items()])
    want = {cols[b]: [keep[b] - 1] for b in sizes if 0 < keep[b] < sizes[b]}
    whole = d.filter(F.col(bin_col).isin([b for b in sizes if keep[b] >= sizes[b]])).drop("_h")
    if not want:
        return whole
    stats = exact_order_stats(dd, want)
    cut = {b: stats[cols[b]][keep[b] - 1] for b in sizes if cols[b] in want}
    by_bin = lambda values: reduce(lambda c, b: c.when(F.col(bin_col) == b, F.lit(values[b])), values, F.when(F.lit(False), F.lit(None)))
    parts = d.filter(F.col(bin_col).isin(list(cut))).withColumn("_cut", by_bin(cut))
    below = parts.filter("_h < _cut")
    got = {r[bin_col]: r["n"] for r in below.groupBy(bin_col).agg(F.count(F.lit(1)).alias("n")).collect()}  # <= bins
    place = F.row_number().over(Window.partitionBy(bin_col).orderBy(*key))
    ties = parts.filter("_h = _cut").withColumn("_place", place).filter(F.col("_place") <= by_bin({b: keep[b] - got.get(b, 0) for b in cut}))
    return whole.unionByName(below.drop("_h", "_cut")).unionByName(ties.drop("_h", "_cut", "_place"))


def _round_half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def union_unify(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, columns missing from a frame filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union (duplicates removed)."""
    return a.unionByName(b).distinct()
