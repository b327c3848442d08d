"""Queries for the feature build, feature scoring/selection, sampling,
timeline, multi-horizon scoring and long export (M10, A16-A18, U2, U3, T6,
F20, S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import recs as RC
from ridgeline.operators import features as FT
from ridgeline.operators import plugins as PL
from ridgeline.operators import predictions as PR
from ridgeline.operators import scenario as S
from ridgeline.operators import tables_ops as TO
from ridgeline.plans import oracle as O
from ridgeline.plans.q_clean import CALC, PREDS
from ridgeline.plans.q_joins import FIN, KFIN, kfin
from ridgeline.plans.q_predictions import BASE, REG, _registry
from ridgeline.plans.registry import query
from ridgeline.session import reliable_checkpoint
from ridgeline.sources import sinks as SK
from ridgeline.sources import tables as T

R = O.READINGS
W6 = "(PARTITION BY asset_id ORDER BY ts, seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
WS = "(PARTITION BY asset_id ORDER BY ts, seq)"

SCORED = ["feed_pb", "kex", "sipx", "air_flow", "level", "feed_pb_lag_1", "kex_lag_1", "feed_pb_roll_mean_30min",
          "level_roll_std_30min", "feed_pb_x_kex", "kex_squared", "hour", "day_of_week"]
FEAT = f"""
feat AS (SELECT seq, asset_id, ts, feed_pb, kex, sipx, air_flow, level,
                lag(feed_pb, 1) OVER {WS} AS feed_pb_lag_1, lag(kex, 1) OVER {WS} AS kex_lag_1,
                avg(feed_pb) OVER {W6} AS feed_pb_roll_mean_30min, stddev_samp(level) OVER {W6} AS level_roll_std_30min,
                feed_pb * kex AS feed_pb_x_kex, kex * kex AS kex_squared, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
                lead(grade, 1) OVER {WS} AS grade_ahead FROM kfin)"""
FCTES = (R, FIN, KFIN, FEAT)


def r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def features(spark, sf):
    return FT.build_features(kfin(spark, sf), T.TAGS, target="grade", horizon_rows=1)


class ReagentLoad(PL.FeatureProcessor):
    """A foreign processor: reagent per unit of feed, its change over twelve rows, share of KEX."""

    requires, names, lookback = ("kex", "sipx", "feed_pb"), ("reagent_load", "reagent_load_change", "kex_share"), 12

    def prepare(self, w):
        load = lambda lag: (F.lag("kex", lag).over(w) + F.lag("sipx", lag).over(w)) / F.nullif(F.lag("feed_pb", lag).over(w), F.lit(0.0))
        return [load(0), load(0) - load(12), F.col("kex") / F.nullif(F.col("kex") + F.col("sipx"), F.lit(0.0))]


_LOAD = "(lag(kex, {0}) OVER {1} + lag(sipx, {0}) OVER {1}) / nullif(lag(feed_pb, {0}) OVER {1}, 0.0)"


@query("foreign_features", O.with_ctes(R, FIN, KFIN, f"""
x AS (SELECT seq, feed_pb, {_LOAD.format(0, WS)} AS a, {_LOAD.format(0, WS)} - {_LOAD.format(12, WS)} AS b, kex / nullif(kex + sipx, 0.0) AS c,
             avg(feed_pb) OVER {W6} AS m FROM kfin)""", body="""
SELECT seq, round(a, 6) AS reagent_load, round(b, 6) AS reagent_load_change, round(c, 6) AS kex_share, round(m, 6) AS feed_pb_roll_mean_30min,
       a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS features_valid FROM x"""))
def foreign_features(spark, sf):
    """A foreign feature processor in the library's feature build."""
    f = FT.build_features(kfin(spark, sf), T.TAGS, processors=[ReagentLoad()])
    return r6(f.select("seq", *ReagentLoad.names, "feed_pb_roll_mean_30min", "features_valid"))


_FB = {"feed_pb_lag_3": f"lag(feed_pb, 3) OVER {WS}", "level_roll_max_30min": f"max(level) OVER {W6}",
       "air_flow_rate_of_change": f"air_flow - lag(air_flow, 1) OVER {WS}",
       "sipx_acceleration": f"sipx - 2 * lag(sipx, 1) OVER {WS} + lag(sipx, 2) OVER {WS}",
       "kex_zscore_30min": f"(kex - avg(kex) OVER {W6}) / nullif(stddev_samp(kex) OVER {W6}, 0)",
       "feed_pb_p75_30min": f"quantile_cont(feed_pb, 0.75) OVER {W6}", "hour_sin": "sin(2 * pi() * hour(ts) / 24)",
       "feed_pb_x_level": "feed_pb * level", "sipx_cubed": "sipx * sipx * sipx", "grade_ahead": f"lead(grade, 1) OVER {WS}",
       "level_lag_5": f"lag(level, 5) OVER {WS}", "month_cos": "cos(2 * pi() * month(ts) / 12)"}


@query("feature_build", O.with_ctes(R, FIN, KFIN, body="SELECT seq, " + ", ".join(
    f"round({e}, 6) AS {n}" for n, e in _FB.items()) + " FROM kfin"))
def feature_build(spark, sf):
    f = features(spark, sf)
    return r6(f.select("seq", *_FB))


@query("f_select", O.with_ctes(*FCTES, """
sc AS (UNPIVOT (SELECT * FROM feat) ON """ + ", ".join(SCORED) + """ INTO NAME feature VALUE x)""", body="""
SELECT feature, round(r, 6) AS r, n, round(r * r / (1 - r * r) * (n - 2), 6) AS f_stat FROM (
  SELECT feature, corr(x, grade_ahead) AS r, count(*) AS n FROM sc WHERE x IS NOT NULL AND grade_ahead IS NOT NULL GROUP BY feature)
ORDER BY f_stat DESC, feature LIMIT 8"""))
def f_select(spark, sf):
    f = features(spark, sf).select(*SCORED, F.col("grade_ahead").alias("grade_ahead"))
    return r6(FT.top_k(FT.f_scores(f, SCORED, "grade_ahead"), "f_stat", 8))


def _mi_sql():
    snapped = ", ".join(f"round({c}, 9) AS {c}" for c in [*SCORED, "grade_ahead"])
    edges = ", ".join(f"quantile_cont({c}, [{', '.join(str(p) for p in FT.DECILES)}]) AS e_{c}" for c in [*SCORED, "grade_ahead"])
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, len(list_filter(e_{c}, lambda e: {c} > e)) AS xb, "
        f"len(list_filter(e_grade_ahead, lambda e: grade_ahead > e)) AS yb FROM fsn, ed "
        f"WHERE {c} IS NOT NULL AND grade_ahead IS NOT NULL" for c in SCORED)
    return [f"fsn AS (SELECT {snapped} FROM feat)", f"ed AS (SELECT {edges} FROM fsn)",
            f"cl AS (SELECT feature, xb, yb, count(*) AS nxy FROM ({cells}) GROUP BY ALL)",
            """c2 AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, xb) AS nx,
                      sum(nxy) OVER (PARTITION BY feature, yb) AS ny FROM cl)"""]


@query("mi_select", O.with_ctes(*FCTES, *_mi_sql(), body="""
SELECT feature, round(mi, 6) AS mi, CAST(n AS BIGINT) AS n FROM (
  SELECT feature, sum((nxy / n) * ln(nxy * n / (nx * ny))) AS mi, any_value(n) AS n FROM c2 GROUP BY feature)
ORDER BY mi DESC, feature LIMIT 8"""))
def mi_select(spark, sf):
    f = features(spark, sf).select(*SCORED, "grade_ahead")
    return r6(FT.top_k(FT.mi_scores(f, SCORED, "grade_ahead"), "mi", 8))


@query("feature_union", O.with_ctes(*FCTES, *_mi_sql(), """
sc AS (UNPIVOT (SELECT * FROM feat) ON """ + ", ".join(SCORED) + """ INTO NAME feature VALUE x)""", """
fs AS (SELECT feature FROM (SELECT feature, corr(x, grade_ahead) AS r, count(*) AS n FROM sc
       WHERE x IS NOT NULL AND grade_ahead IS NOT NULL GROUP BY feature) ORDER BY r * r / (1 - r * r) * (n - 2) DESC, feature LIMIT 5)""", """
ms AS (SELECT feature FROM (SELECT feature, sum((nxy / n) * ln(nxy * n / (nx * ny))) AS mi FROM c2 GROUP BY feature)
       ORDER BY mi DESC, feature LIMIT 5)""", body="SELECT feature FROM fs UNION SELECT feature FROM ms"))
def feature_union(spark, sf):
    f = features(spark, sf).select(*SCORED, "grade_ahead").cache()
    a = FT.top_k(FT.f_scores(f, SCORED, "grade_ahead"), "f_stat", 5).select("feature")
    b = FT.top_k(FT.mi_scores(f, SCORED, "grade_ahead"), "mi", 5).select("feature")
    return TO.distinct_union(a, b)


@query("target_deciles", O.with_ctes(R, CALC, body="""
SELECT DISTINCT round(unnest(quantile_cont(grade, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])), 6) AS edge FROM calc"""))
def target_deciles(spark, sf):
    c = _calc_once(spark, sf)
    edges = FT.decile_edges(c, ["grade"])["grade"]
    return spark.createDataFrame([(e,) for e in edges], "edge double").select(F.round("edge", 6).alias("edge")).distinct()


def _calc_once(spark, sf):
    """The calc table feeds several passes (profile, refinement rounds, bin
    sizes, sampling): materialise its cadence aggregation once."""
    return reliable_checkpoint(T.calc(T.readings(spark, sf)))


def _binned_calc(spark, sf):
    c = _calc_once(spark, sf)
    edges = FT.decile_edges(c, ["grade"])["grade"]
    return c.withColumn("bin", FT.bin_of(F.col("grade"), edges))


@query("sample_stratified")
def sample_stratified(spark, sf):
    return TO.sample_stratified(_binned_calc(spark, sf), "bin", 0.3)


@query("sample_stratified_counts", O.with_ctes(R, CALC, """
ed AS (SELECT quantile_cont(grade, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM calc)""", body="""
SELECT bin, count(*) AS n_bin, CAST(round(count(*) * 0.3) AS BIGINT) AS n_sampled FROM (
  SELECT len(list_filter(e, lambda x: grade > x)) AS bin FROM calc, ed) GROUP BY bin"""))
def sample_stratified_counts(spark, sf):
    b = _binned_calc(spark, sf)
    s = TO.sample_stratified(b, "bin", 0.3).groupBy("bin").agg(F.count(F.lit(1)).alias("n_sampled"))
    n = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n_bin"))
    return n.join(s, "bin", "left").select(F.col("bin").cast("int").alias("bin"), "n_bin",
                                           F.coalesce("n_sampled", F.lit(0)).cast("bigint").alias("n_sampled"))


@query("forecast_timeline", O.with_ctes(R, CALC, PREDS, body="""
SELECT asset_id, 'history' AS kind, ts, CAST(NULL AS INTEGER) AS horizon, round(grade, 6) AS value FROM calc
UNION ALL
SELECT asset_id, 'current', ts, NULL, round(grade, 6) FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, seq DESC) AS rk FROM calc) WHERE rk = 1
UNION ALL
SELECT asset_id, 'forecast', ts + to_minutes(horizon) + to_seconds(10 * (CASE horizon WHEN 5 THEN 0 WHEN 15 THEN 1 WHEN 30 THEN 2 ELSE 3 END)),
       horizon, round(prediction, 6) FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id, horizon ORDER BY ts DESC, seq DESC) AS rk FROM preds) WHERE rk = 1"""))
def forecast_timeline(spark, sf):
    from pyspark.sql import Window
    r = T.readings(spark, sf)
    c = T.calc(r)
    hist = c.select("asset_id", F.lit("history").alias("kind"), "ts", F.lit(None).cast("int").alias("horizon"),
                    F.col("grade").alias("value"))
    cur = (c.withColumn("_rk", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.col("ts").desc(), F.col("seq").desc())))
            .filter("_rk = 1").select("asset_id", F.lit("current").alias("kind"), "ts",
                                      F.lit(None).cast("int").alias("horizon"), F.col("grade").alias("value")))
    p = T.preds(r)
    last = (p.withColumn("_rk", F.row_number().over(
        Window.partitionBy("asset_id", "horizon").orderBy(F.col("ts").desc(), F.col("seq").desc()))).filter("_rk = 1"))
    idx = F.when(F.col("horizon") == 5, 0).when(F.col("horizon") == 15, 1).when(F.col("horizon") == 30, 2).otherwise(3)
    fut = last.select("asset_id", F.lit("forecast").alias("kind"),
                      (F.col("ts") + F.make_dt_interval(mins=F.col("horizon")) + F.make_dt_interval(secs=idx * 10)).alias("ts"),
                      F.col("horizon").cast("int"), F.col("prediction").alias("value"))
    return r6(TO.union_unify([hist, cur, fut]))


def _mh_sql():
    pred = O.grade("feed_pb", "cand_kex", "cand_sipx", "air_flow", "level")
    terms = []
    for h in S.MULTI_HORIZONS:
        s = (f"(CASE WHEN pg BETWEEN 15.0 AND 35.0 THEN 1.0 ELSE greatest(0.0, 1.0 - least(abs(pg - 15.0), abs(pg - 35.0)) / 5.0) END)"
             f" * (1.0 - (1.0 - r2_{h}) * 0.3) * {1.0 / h!r}")
        terms.append(s)
    r2s = ", ".join(f"max(r2) FILTER (WHERE horizon = {h}) AS r2_{h}" for h in S.MULTI_HORIZONS)
    total = "0.0 + " + " + ".join(terms)
    cands = ("cands AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}::DOUBLE, {s_}::DOUBLE)" for i, k, s_ in S.CANDIDATES)
             + ") t(cand_id, cand_kex, cand_sipx))")
    return [cands, f"rr AS (SELECT {r2s} FROM reg WHERE model = 'logged')",
            f"mh AS (SELECT k.seq, c.cand_id, {pred} AS pg, rr.* FROM kfin k, cands c, rr)"], total


_MH, _MH_TOTAL = _mh_sql()


@query("multi_horizon_score", O.with_ctes(R, FIN, KFIN, CALC, PREDS, BASE[-1], REG, *_MH, body=f"""
SELECT seq, cand_id, pg AS predicted_grade, round({_MH_TOTAL}, 6) AS total_score FROM mh"""))
def multi_horizon_score(spark, sf):
    reg = _registry(spark, sf).filter(F.col("model") == "logged").select("horizon", "r2").collect()  # 4 rows
    r2 = {row["horizon"]: F.lit(row["r2"]) for row in reg}
    s = S.multi_horizon_score(kfin(spark, sf), r2)
    return s.select("seq", "cand_id", "predicted_grade", F.round("total_score", 6).alias("total_score"))


def _mh_text_sql():
    f1 = lambda x: f"printf('%.1f', {O.rhu(x, 1)})"
    kinds = [(RC.MSG_MH_IN, True), (RC.MSG_MH_OUT, False)]
    lo, hi = RC.MH_TARGET
    per = []
    for h in S.MULTI_HORIZONS:
        text = {inside: "'" + m.replace("%s%%", "{v}").replace("%smin", f"{h}min").replace("%%", "%") + "'" for m, inside in kinds}
        both = {k: v.replace("{v}", f"' || {f1('pg')} || '%", 1).replace("{v}", f"' || {f1(f'r2_{h} * 100.0')} || '%", 1) for k, v in text.items()}
        per.append(f"CASE WHEN r2_{h} IS NOT NULL THEN CASE WHEN pg BETWEEN {lo} AND {hi} THEN {both[True]} ELSE {both[False]} END END")
    change = [f"CASE WHEN abs({o} - {c}) > {least} THEN (CASE WHEN {o} > {c} THEN 'Increase' ELSE 'Decrease' END) || ' {name} from ' || {f1(c)} || ' to ' || {f1(o)} || ' L/min' END"
              for name, c, o, least in (("KEX", "ck", "cand_kex", RC.MH_KEX_CHANGE), ("SIPX", "cs", "cand_sipx", RC.MH_SIPX_CHANGE))]
    mean = "((0.0" + "".join(f" + coalesce(r2_{h}, 0.8)" for h in S.MULTI_HORIZONS) + f") / {len(S.MULTI_HORIZONS)}.0)"
    low = f"CASE WHEN {mean} < {RC.MH_LEAST_CONFIDENCE} THEN 'Low prediction confidence (' || {f1(mean + ' * 100.0')} || '%) - consider manual verification' END"
    score = f"'Multi-horizon optimization score: ' || printf('%.3f', {O.rhu('total_score', 3)})"
    said = f"list_filter([{', '.join([score, *per, *change, low])}], lambda m: m IS NOT NULL)"
    return f"CASE WHEN total_score IS NULL THEN ['{RC.MSG_MH_FAILED}'] ELSE {said} END"


@query("multi_horizon_recommendations", O.with_ctes(R, FIN, KFIN, CALC, PREDS, BASE[-1], REG, _MH[0], _MH[1], f"""
mh AS (SELECT k.seq, coalesce(k.kex, 60.0) AS ck, coalesce(k.sipx, 30.0) AS cs, c.*, {O.grade("feed_pb", "cand_kex", "cand_sipx", "air_flow", "level")} AS pg, rr.*
       FROM kfin k, cands c, rr)""", f"""
best AS (SELECT *, round({_MH_TOTAL}, 9) AS total_score FROM mh
         QUALIFY row_number() OVER (PARTITION BY seq ORDER BY round({_MH_TOTAL}, 9) DESC, cand_id) = 1)""", body=f"""
SELECT seq, cand_id, array_to_string({_mh_text_sql()}, ' | ') AS recommendations FROM best"""))
def multi_horizon_recommendations(spark, sf):
    """texts of the candidate that scores best over all horizons."""
    reg = _registry(spark, sf).filter(F.col("model") == "logged").select("horizon", "r2").collect()  # 4 rows
    r2 = {row["horizon"]: F.lit(row["r2"]) for row in reg}
    s = S.multi_horizon_score(kfin(spark, sf), r2).withColumn("total_score", F.round("total_score", 9))
    b = s.groupBy("seq").agg(F.max_by(F.struct("kex", "sipx", "cand_id", "cand_kex", "cand_sipx", "predicted_grade", "total_score"),
                                      F.struct("total_score", -F.col("cand_id"))).alias("b")).select("seq", "b.*")
    texts = RC.multi_horizon_messages(
        F.col("total_score"), {h: (F.col("predicted_grade"), r2[h]) for h in S.MULTI_HORIZONS},
        F.coalesce("kex", F.lit(60.0)), F.coalesce("sipx", F.lit(30.0)), F.col("cand_kex"), F.col("cand_sipx"))
    return b.select("seq", "cand_id", F.array_join(texts, " | ").alias("recommendations"))


_EXP = " UNION ALL ".join(
    f"SELECT seq, '{label}' AS Parameter, coalesce({c}, 0.0) AS Value, '{unit}' AS Unit, ts AS Timestamp FROM kfin"
    for c, label, unit in SK.EXPORT_ROWS)


@query("export_long", O.with_ctes(R, FIN, KFIN, body=f"SELECT seq, Parameter, round(Value, 6) AS Value, Unit, Timestamp FROM ({_EXP})"))
def export_long(spark, sf):
    e = SK.export_long(kfin(spark, sf))
    return e.select("seq", "Parameter", F.round("Value", 6).alias("Value"), "Unit", "Timestamp")


_ = PR
