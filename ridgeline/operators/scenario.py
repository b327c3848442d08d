"""Scenario search over reagent settings.

Every decision point (a reading) is scored against a fixed candidate grid.
The grid is a constant of the code, so it is expanded with ``explode`` of a
literal array (a Generate, not a join), and the six simulated time steps are
inline column arithmetic.  Per-point results (best candidate, improvement,
variability) come from one aggregation by point.  The points are dealt by that
key before they are expanded, so the search runs on all cores however few files
or splits hold the readings, and the aggregation needs no other shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.session import compile_wide_stages

# --- fixed values that must equal the reference's ---------------------------
CANDIDATES = [(1, 50.0, 30.0), (2, 60.0, 25.0), (3, 40.0, 35.0), (4, 55.0, 28.0),
              (5, 45.0, 32.0), (6, 70.0, 20.0), (7, 30.0, 40.0)]    # (id, KEX, SIPX)
TIME_STEPS, RAMP_STEPS = 6, 3
BOUNDS = {"kex": (20.0, 100.0), "sipx": (10.0, 60.0)}
BASE_FLOW = 100.0
CURRENT_DEFAULT = (60.0, 30.0)      # current setting when a tag is missing
RAMP_DEFAULT = (45.0, 25.0)         # state used for the ramp when missing
GRADE_PENALTY, BOUNDS_PENALTY = 0.1, 0.1
VARIABILITY_CLAMP = (0.05, 0.3)
MULTI_HORIZONS = (5, 15, 30, 60)
STEP_MINUTES = 10                   # between simulated steps
# ---------------------------------------------------------------------------
GRADE_BAND = (15.0, 35.0)           # section 8: band is a parameter


def _step_settings(rk: Column, rs: Column, cand_kex: Column, cand_sipx: Column) -> list[tuple[Column, Column]]:
    """effective (kex, sipx) of each distinct step: the setting ramps in
    linearly over the first three steps, then holds."""
    out = []
    for s in range(RAMP_STEPS):
        f = (s + 1) / RAMP_STEPS
        out.append((rk * (1 - f) + cand_kex * f, rs * (1 - f) + cand_sipx * f))
    return out


def _step_index(s: int) -> int:
    return min(s, RAMP_STEPS - 1)   # steps 2..5 share the full setting


def candidate_rows(points: DataFrame, band=GRADE_BAND, with_current: bool = True, key: str = "seq") -> DataFrame:
    """A20 for every candidate: one row per (point, candidate), staged.

    Candidates come from ``inline`` of a literal array (a Generate, not a
    join).  Stage 1 computes the grade of each distinct step, stage 2 its
    tailings grade, stage 3 the recovery from those columns, stage 4 the
    summaries; separate
    projections keep each formula a column reference instead of a
    re-inlined tree (CollapseProject does not merge projections that would
    duplicate non-trivial expressions), so generated code stays small.  The
    points are dealt by ``key`` first."""
    compile_wide_stages(points.sparkSession)
    points = points.repartition(F.col(key))
    ck, cs = _current(points)
    rk = F.coalesce(F.col("kex"), F.lit(RAMP_DEFAULT[0]))
    rs = F.coalesce(F.col("sipx"), F.lit(RAMP_DEFAULT[1]))
    items = ([F.struct(F.lit(0).alias("cand_id"), ck.alias("cand_kex"), cs.alias("cand_sipx"))] if with_current else [])
    items += [F.struct(F.lit(i).alias("cand_id"), F.lit(k).alias("cand_kex"), F.lit(sx).alias("cand_sipx"))
              for i, k, sx in CANDIDATES]
    x = points.select("*", ck.alias("current_kex"), cs.alias("current_sipx"), F.inline(F.array(*items)))
    feed, air, level = F.col("feed_pb"), F.col("air_flow"), F.col("level")
    kc, sc = F.col("cand_kex"), F.col("cand_sipx")
    st1, st_t, st2 = [], [], []
    for j, (k, sp) in enumerate(_step_settings(rk, rs, kc, sc)):
        st1 += [k.alias(f"_k{j}"), sp.alias(f"_s{j}"), P.grade_estimate(feed, k, sp, air, level).alias(f"_g{j}")]
        st_t.append(P.tailings_grade(feed, F.col(f"_k{j}"), F.col(f"_s{j}"), air, level).alias(f"_t{j}"))
        st2.append((P.recovery_two_product(F.col(f"_g{j}"), feed, F.col(f"_k{j}"), F.col(f"_s{j}"), air, level,
                                           tailings=F.col(f"_t{j}")) / 100.0).alias(f"_r{j}"))
    x = x.select("*", *st1).select("*", *st_t).select("*", *st2)
    n = TIME_STEPS
    gs = [F.col(f"_g{_step_index(t)}") for t in range(n)]
    rs_ = [F.col(f"_r{_step_index(t)}") for t in range(n)]
    mr, mg = _mean(rs_), _mean(gs)
    lo, hi = band
    gpen = (F.when(mg < lo, (F.lit(lo) - mg) * GRADE_PENALTY)
             .when(mg > hi, (mg - F.lit(hi)) * GRADE_PENALTY).otherwise(F.lit(0.0)))
    breaches = (F.when(~kc.between(*BOUNDS["kex"]), 1.0).otherwise(0.0)
                + F.when(~sc.between(*BOUNDS["sipx"]), 1.0).otherwise(0.0))
    x = x.select(*points.columns, "current_kex", "current_sipx", "cand_id", "cand_kex", "cand_sipx",
                 mr.alias("avg_recovery"), mg.alias("avg_concentrate"), _std_pop(rs_).alias("std_recovery"),
                 _std_pop(gs).alias("std_concentrate"), gpen.alias("grade_penalty"), breaches.alias("bounds_penalty"))
    return x.withColumn("objective", F.col("avg_recovery") - F.col("grade_penalty") - F.col("bounds_penalty") * BOUNDS_PENALTY)


def _mean(xs):
    return sum(xs[1:], xs[0]) / float(len(xs))


def _std_pop(xs):
    m = _mean(xs)
    return F.sqrt(_mean([(x - m) * (x - m) for x in xs]))


def _current(df: DataFrame):
    return (F.coalesce(F.col("kex"), F.lit(CURRENT_DEFAULT[0])), F.coalesce(F.col("sipx"), F.lit(CURRENT_DEFAULT[1])))


def grid_literal() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("cand_id"), F.lit(k).alias("cand_kex"), F.lit(s).alias("cand_sipx"))
                     for i, k, s in CANDIDATES])


def scenario_steps(points: DataFrame) -> DataFrame:
    """J5 + F21: one row per (point, candidate, step) with the effective
    settings, grade, recovery and flow (candidate 0 = current setting)."""
    ck, cs = _current(points)
    cands = F.array(F.struct(F.lit(0).alias("cand_id"), ck.alias("cand_kex"), cs.alias("cand_sipx")),
                    *[F.struct(F.lit(i).alias("cand_id"), F.lit(k).alias("cand_kex"), F.lit(s).alias("cand_sipx"))
                      for i, k, s in CANDIDATES])
    x = points.select("*", F.inline(cands)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(TIME_STEPS - 1))))
    f = (F.col("step") + 1) / float(RAMP_STEPS)
    rk = F.coalesce(F.col("kex"), F.lit(RAMP_DEFAULT[0]))
    rs = F.coalesce(F.col("sipx"), F.lit(RAMP_DEFAULT[1]))
    ramp = F.col("step") < RAMP_STEPS
    x = (x.withColumn("kex_eff", F.when(ramp, rk * (1 - f) + F.col("cand_kex") * f).otherwise(F.col("cand_kex")))
          .withColumn("sipx_eff", F.when(ramp, rs * (1 - f) + F.col("cand_sipx") * f).otherwise(F.col("cand_sipx"))))
    g = P.grade_estimate("feed_pb", "kex_eff", "sipx_eff", "air_flow", "level")
    x = P.with_recovery(x.withColumn("sim_grade", g), "sim_recovery", "sim_grade", "feed_pb", "kex_eff",
                        "sipx_eff", "air_flow", "level", divisor=100.0)
    return x.withColumn("flow_rate", F.lit(BASE_FLOW) * (F.lit(1.0) + (F.col("sim_recovery") - 0.85) * 0.5))


def scenario_objective(points: DataFrame, band=GRADE_BAND) -> DataFrame:
    """One row per (point, candidate) with its summary and objective."""
    return candidate_rows(points, band)


def best_scenario(points: DataFrame, key: str = "seq") -> DataFrame:
    """A21 + A15: per point the grid candidate with the highest mean recovery
    (first in grid order on ties), the improvement over the current setting
    and the variability of the current setting.

    The eight candidate rows of a point are produced next to each other in
    the task that its key was dealt to and aggregated there."""
    c = candidate_rows(points, key=key)
    is_cur = F.col("cand_id") == 0
    rank_key = F.when(~is_cur, F.struct(F.col("avg_recovery"), (F.lit(0) - F.col("cand_id")).alias("neg_id")))
    g = c.groupBy(key).agg(
        F.max_by(F.struct("cand_id", "cand_kex", "cand_sipx", "avg_recovery", "avg_concentrate"), rank_key).alias("b"),
        F.max_by(F.struct("current_kex", "current_sipx", "avg_recovery", "avg_concentrate", "std_recovery",
                          "std_concentrate"), F.when(is_cur, F.lit(1))).alias("c"))
    variability = F.greatest(F.lit(VARIABILITY_CLAMP[0]), F.least(
        F.lit(VARIABILITY_CLAMP[1]), (F.col("c.std_recovery") + F.col("c.std_concentrate")) / 2.0))
    return g.select(
        key, F.col("c.current_kex").alias("current_kex"), F.col("c.current_sipx").alias("current_sipx"),
        F.col("b.cand_id").alias("best_cand"), F.col("b.cand_kex").alias("optimal_kex"),
        F.col("b.cand_sipx").alias("optimal_sipx"),
        F.col("c.avg_recovery").alias("current_avg_recovery"), F.col("b.avg_recovery").alias("optimal_avg_recovery"),
        (F.col("b.avg_recovery") - F.col("c.avg_recovery")).alias("recovery_improvement"),
        F.col("c.avg_concentrate").alias("current_avg_concentrate"),
        F.col("b.avg_concentrate").alias("optimal_avg_concentrate"), variability.alias("process_variability"))


def multi_horizon_score(points: DataFrame, r2_by_horizon: dict[int, Column], band=GRADE_BAND) -> DataFrame:
    """for each candidate, score its predicted grade per horizon: 1 in
    the band, else max(0, 1 - distance / 5); times 1 - (1 - r2) * 0.3;
    weighted 1/h and summed.  ``r2_by_horizon`` are Columns (joined metrics)."""
    lo, hi = band
    x = points.select("*", F.inline(grid_literal()))
    pred = P.grade_estimate(F.col("feed_pb"), F.col("cand_kex"), F.col("cand_sipx"), F.col("air_flow"), F.col("level"))
    total = F.lit(0.0)
    for h in MULTI_HORIZONS:
        dist = F.least(F.abs(pred - lo), F.abs(pred - hi))
        s = F.when(pred.between(lo, hi), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - dist / 5.0))
        s = s * (F.lit(1.0) - (F.lit(1.0) - r2_by_horizon[h]) * 0.3)
        total = total + s * (1.0 / h)
    return x.select("*", pred.alias("predicted_grade"), total.alias("total_score"))
