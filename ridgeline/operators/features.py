"""Feature catalogue and the full feature build (M10), feature scoring and
selection (A16-A18, U2) and stratified sampling support (T6).

The catalogue lists (name, base, kind) so column pruning after selection
can rebuild only the chosen features.  All window features of one build
share one WindowSpec on the halo-chunked plan: one exchange, one sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import plugins as PL
from ridgeline.functions import calendar as CAL
from ridgeline.operators import windows as W
from ridgeline.operators.quantiles import exact_quantiles
from ridgeline.plans import halo as H
from ridgeline.session import reliable_checkpoint

# --- fixed values that must equal the reference's ---------------------------
LAGS = (1, 2, 3, 4, 5)
N_INTERACT, N_POLY, N_STATS = 5, 3, 10
DECILES = [i / 10 for i in range(1, 10)]
# ---------------------------------------------------------------------------


def window_features(w, base: Sequence[str], stats_cols: Sequence[str] | None = None) -> list[Column]:
    """W1, W5, W8, W9, W11-W13 over ``base`` on one window spec."""
    stats_cols = list(stats_cols if stats_cols is not None else list(base)[:N_STATS])
    return [*W.lag_rows(w, base, LAGS), *W.rolling_basic(w, base), *W.rate_of_change(w, base),
            *W.acceleration(w, base), *W.rolling_zscore(w, stats_cols), *W.rolling_quantiles(w, stats_cols),
            *W.rolling_shape(w, stats_cols)]


def catalogue(base: Sequence[str]) -> list[tuple[str, str, str]]:
    """(feature, base column, kind) for the base-only build."""
    out = []
    for c in base:
        out += [(f"{c}_lag_{k}", c, "lag") for k in LAGS]
        out += [(f"{c}_roll_{s}_30min", c, "rolling") for s in ("mean", "std", "min", "max")]
        out += [(f"{c}_rate_of_change", c, "diff"), (f"{c}_acceleration", c, "diff2")]
    for c in list(base)[:N_STATS]:
        out += [(f"{c}_{s}_30min", c, "stats") for s in ("zscore", "p25", "p75", "skew", "kurt")]
    k = list(base)[:N_INTERACT]
    out += [(f"{a}_x_{b}", f"{a},{b}", "interaction") for i, a in enumerate(k) for b in k[i + 1:]]
    out += [(f"{c}_{p}", c, "polynomial") for c in list(base)[:N_POLY] for p in ("squared", "cubed")]
    return out


def build_features(df: DataFrame, base: Sequence[str], keys=("asset_id",), order=("ts", "seq"), ts: str = "ts",
                   target: str | None = None, horizon_rows: int = 1, chunk_rows: int = H.DEFAULT_CHUNK_ROWS,
                   horizons: dict[int, int] | None = None, processors: Sequence[PL.FeatureProcessor] = ()) -> DataFrame:
    """Calendar, products, powers and all window features in one
    chunked window pass; optional labels: ``{target}_ahead`` (lead by
    ``horizon_rows``) and ``{target}_{h}min_ahead`` for ``horizons``
    {minutes: rows} (W17).  ``processors`` (X2) add their features in the same
    window pass, and ``features_valid``."""
    ahead = [horizon_rows] if target is not None else []
    if horizons:
        ahead += list(horizons.values())

    def build(w):
        cols = window_features(w, base)
        if target is not None:
            cols.append(F.lead(target, horizon_rows).over(w).alias(f"{target}_ahead"))
            for h, rows in (horizons or {}).items():
                cols.append(F.lead(target, rows).over(w).alias(f"{target}_{h}min_ahead"))
        for p in processors:
            cols += PL.prepared(df.columns, p, w)
        return cols

    # window pass first on the narrow input (what gets sorted and checkpointed),
    # row-local features after it: unused ones are pruned by Catalyst
    win = H.row_windowed(df, list(keys), list(order), build, lookback=max(W.ROLL_ROWS - 1, max(LAGS), 2, *[p.lookback for p in processors]),
                         lookahead=max(ahead) if ahead else 0, chunk_rows=chunk_rows)
    if processors:
        win = PL.checked_features(win, processors)
    return win.select("*", *CAL.time_features(ts), *CAL.interactions(base, N_INTERACT), *CAL.polynomials(base, N_POLY))


def f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """r = corr(x, y), F = r^2 / (1 - r^2) * (n - 2) over complete pairs;
    one aggregation pass for all features, then a one-row unpivot."""
    aggs = []
    for i, c in enumerate(features):
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        aggs += [F.corr(F.when(both, F.col(c)), F.when(both, F.col(target))).alias(f"r{i}"),
                 F.count(F.when(both, F.lit(1))).alias(f"n{i}")]
    row = df.agg(*aggs)
    stacked = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"),
                                                     F.col(f"n{i}").alias("n")) for i, c in enumerate(features)])))
    r2 = F.col("r") * F.col("r")
    return stacked.withColumn("f_stat", F.when(r2 < 1, r2 / (F.lit(1.0) - r2) * (F.col("n") - 2)))


def decile_edges(df: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """A18 helper: exact decile edges per column (nine values each)."""
    return exact_quantiles(df, list(cols), DECILES)


def bin_of(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed quantile bin: number of edges strictly below the value."""
    return sum((F.when(c > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))


def mi_scores(df: DataFrame, features: Sequence[str], target: str, snap: int = 9) -> DataFrame:
    """Binned mutual information (decile bins of feature and target)
    in nats: sum p(x,y) ln(p(x,y) / (p(x) p(y))) over complete pairs.  One
    ``groupBy(feature, xbin, ybin).count()`` with map-side combine.  Values
    are snapped to ``snap`` decimals first so bins do not hinge on the last
    bit of a computed feature."""
    feats = list(features)
    # three passes (profile, edges, counts) read the snapped columns: cut the
    # lineage once so the feature windows are not recomputed per pass
    df = reliable_checkpoint(df.select(*[F.round(F.col(c), snap).alias(c) for c in [*feats, target]]))
    edges = decile_edges(df, [*feats, target])
    # bins first (each computed once per row), then the explode refers to
    # the bin columns: Catalyst keeps the stages apart because the target
    # bin is used by every feature's entry
    bins = df.select(*[F.when(F.col(c).isNotNull(), bin_of(F.col(c), edges[c])).alias(f"_xb{i}")
                       for i, c in enumerate(feats)],
                     F.when(F.col(target).isNotNull(), bin_of(F.col(target), edges[target])).alias("_yb"))
    items = [F.when(F.col(f"_xb{i}").isNotNull() & F.col("_yb").isNotNull(),
                    F.struct(F.lit(c).alias("feature"), F.col(f"_xb{i}").alias("xb"), F.col("_yb").alias("yb")))
             for i, c in enumerate(feats)]
    cells = (bins.select(F.explode(F.array(*items)).alias("t")).filter(F.col("t").isNotNull())
               .groupBy("t.feature", "t.xb", "t.yb").agg(F.count(F.lit(1)).alias("nxy")))
    # a feature has at most 10 x 10 cells (decile bins), a bound fixed by the
    # code: gather them per feature and take the marginals in-row with
    # higher-order functions (one shuffle instead of one per marginal).
    # Counts are multiplied as doubles: n * nxy overflows a long at scale.
    g = cells.groupBy("feature").agg(F.collect_list(F.struct("xb", "yb", "nxy")).alias("c"))
    zero = F.lit(0).cast("long")

    def total(arr):
        return F.aggregate(arr, zero, lambda acc, y: acc + y["nxy"])

    n = total(F.col("c"))
    g = g.select("feature", "c", n.alias("n"))

    def term(x):
        nx = total(F.filter("c", lambda y: y["xb"] == x["xb"])).cast("double")
        ny = total(F.filter("c", lambda y: y["yb"] == x["yb"])).cast("double")
        nxy, nn = x["nxy"].cast("double"), F.col("n").cast("double")
        return (nxy / nn) * F.log(nxy * nn / (nx * ny))

    mi = F.aggregate(F.transform("c", term), F.lit(0.0), lambda acc, v: acc + v)
    return g.select("feature", mi.alias("mi"), "n")


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """T4: best k features by score (name breaks ties)."""
    return scores.orderBy(F.col(score).desc_nulls_last(), F.col("feature")).limit(k)


_ = math
