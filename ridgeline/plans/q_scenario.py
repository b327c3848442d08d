"""Queries for scenario search and recommendations (J5, F13-F16, F18, F20-F22,
A15, A20, A21, T3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.functions import recs as RC
from ridgeline.operators import scenario as S
from ridgeline.plans import oracle as O
from ridgeline.plans.q_joins import FIN, KFIN, kfin
from ridgeline.plans.registry import query

R = O.READINGS


def r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CANDS = ("cands AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}::DOUBLE, {s}::DOUBLE)" for i, k, s in S.CANDIDATES)
         + ") t(cand_id, cand_kex, cand_sipx))")
PC = """pc AS (SELECT *, coalesce(kex, 60.0) AS ck, coalesce(sipx, 30.0) AS cs FROM kfin)"""
X = """x AS (SELECT pc.*, 0 AS cand_id, ck AS cand_kex, cs AS cand_sipx FROM pc
      UNION ALL SELECT pc.*, c.cand_id, c.cand_kex, c.cand_sipx FROM pc, cands c)"""


def _steps_sql():
    ks, ss = [], []
    for s in range(S.RAMP_STEPS):  # later steps hold the full setting
        f = (s + 1) / S.RAMP_STEPS
        ks.append(f"coalesce(kex, 45.0) * {1 - f!r} + cand_kex * {f!r} AS k{s}")
        ss.append(f"coalesce(sipx, 25.0) * {1 - f!r} + cand_sipx * {f!r} AS s{s}")
    steps = [min(s, S.RAMP_STEPS - 1) for s in range(S.TIME_STEPS)]
    g = ", ".join(f"{O.grade('feed_pb', f'k{s}', f's{s}', 'air_flow', 'level')} AS g{s}" for s in range(S.RAMP_STEPS))
    r = ", ".join(f"{O.recovery_pct(f'g{s}', 'feed_pb', f'k{s}', f's{s}', 'air_flow', 'level')} / 100.0 AS r{s}"
                  for s in range(S.RAMP_STEPS))
    n = float(S.TIME_STEPS)
    mean = lambda p: "(" + " + ".join(f"{p}{i}" for i in steps) + f") / {n}"
    std = lambda p: "sqrt((" + " + ".join(f"({p}{i} - m{p}) * ({p}{i} - m{p})" for i in steps) + f") / {n})"
    return [f"xs AS MATERIALIZED (SELECT *, {', '.join(ks)}, {', '.join(ss)} FROM x)",
            f"xg AS MATERIALIZED (SELECT *, {g} FROM xs)",
            f"xr AS MATERIALIZED (SELECT *, {r} FROM xg)",
            f"xm AS MATERIALIZED (SELECT *, {mean('r')} AS mr, {mean('g')} AS mg FROM xr)",
            f"""obj AS MATERIALIZED (SELECT *, mr AS avg_recovery, mg AS avg_concentrate, {std('r')} AS std_recovery, {std('g')} AS std_concentrate,
                  CASE WHEN mg < 15.0 THEN (15.0 - mg) * 0.1 WHEN mg > 35.0 THEN (mg - 35.0) * 0.1 ELSE 0.0 END AS grade_penalty,
                  (CASE WHEN NOT (cand_kex BETWEEN 20.0 AND 100.0) THEN 1.0 ELSE 0.0 END
                   + CASE WHEN NOT (cand_sipx BETWEEN 10.0 AND 60.0) THEN 1.0 ELSE 0.0 END) AS bounds_penalty FROM xm)"""]


SCEN = (R, FIN, KFIN, CANDS, PC, X, *_steps_sql())


def points(spark, sf):
    return kfin(spark, sf)


@query("scenario_objective", O.with_ctes(*SCEN, body="""
SELECT seq, cand_id, cand_kex, cand_sipx, round(avg_recovery, 6) AS avg_recovery, round(avg_concentrate, 6) AS avg_concentrate,
       round(grade_penalty, 6) AS grade_penalty, bounds_penalty, round(avg_recovery - grade_penalty - bounds_penalty * 0.1, 6) AS objective
FROM obj"""))
def scenario_objective(spark, sf):
    o = S.scenario_objective(points(spark, sf))
    return r6(o.select("seq", "cand_id", "cand_kex", "cand_sipx", "avg_recovery", "avg_concentrate", "grade_penalty",
                       "bounds_penalty", "objective"))


BEST = """
best AS MATERIALIZED (SELECT o.seq, o.ck AS current_kex, o.cs AS current_sipx, b.cand_id AS best_cand, b.cand_kex AS optimal_kex, b.cand_sipx AS optimal_sipx,
                o.avg_recovery AS current_avg_recovery, b.avg_recovery AS optimal_avg_recovery,
                b.avg_recovery - o.avg_recovery AS recovery_improvement, o.avg_concentrate AS current_avg_concentrate,
                b.avg_concentrate AS optimal_avg_concentrate,
                greatest(0.05, least(0.3, (o.std_recovery + o.std_concentrate) / 2.0)) AS process_variability
         FROM (SELECT * FROM obj WHERE cand_id = 0) o
         JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY avg_recovery DESC, cand_id) AS rk
                              FROM obj WHERE cand_id > 0) WHERE rk = 1) b USING (seq))"""


@query("best_scenario", O.with_ctes(*SCEN, BEST, body="""
SELECT seq, current_kex, current_sipx, best_cand, optimal_kex, optimal_sipx, round(current_avg_recovery, 6) AS current_avg_recovery,
       round(optimal_avg_recovery, 6) AS optimal_avg_recovery, round(recovery_improvement, 6) AS recovery_improvement,
       round(current_avg_concentrate, 6) AS current_avg_concentrate, round(optimal_avg_concentrate, 6) AS optimal_avg_concentrate
FROM best"""))
def best_scenario(spark, sf):
    b = S.best_scenario(points(spark, sf))
    return r6(b.select("seq", "current_kex", "current_sipx", "best_cand", "optimal_kex", "optimal_sipx",
                       "current_avg_recovery", "optimal_avg_recovery", "recovery_improvement",
                       "current_avg_concentrate", "optimal_avg_concentrate"))


@query("process_variability", O.with_ctes(*SCEN, BEST, body="SELECT seq, round(process_variability, 6) AS process_variability FROM best"))
def process_variability(spark, sf):
    return r6(S.best_scenario(points(spark, sf)).select("seq", "process_variability"))


@query("scenario_grid", O.with_ctes(R, FIN, KFIN, CANDS, PC, X, f"""
st AS (SELECT x.*, s.step,
              CASE WHEN s.step < 3 THEN coalesce(kex, 45.0) * (1 - (s.step + 1) / 3.0::DOUBLE) + cand_kex * ((s.step + 1) / 3.0::DOUBLE) ELSE cand_kex END AS kex_eff,
              CASE WHEN s.step < 3 THEN coalesce(sipx, 25.0) * (1 - (s.step + 1) / 3.0::DOUBLE) + cand_sipx * ((s.step + 1) / 3.0::DOUBLE) ELSE cand_sipx END AS sipx_eff
       FROM x, (SELECT range AS step FROM range(6)) s)""", f"""
sg AS (SELECT *, {O.grade('feed_pb', 'kex_eff', 'sipx_eff', 'air_flow', 'level')} AS sim_grade FROM st)""", body=f"""
SELECT seq, cand_id, step, round(kex_eff, 6) AS kex_eff, round(sipx_eff, 6) AS sipx_eff, sim_grade,
       {O.recovery_pct('sim_grade', 'feed_pb', 'kex_eff', 'sipx_eff', 'air_flow', 'level')} / 100.0 AS sim_recovery,
       round(100.0 * (1.0 + ({O.recovery_pct('sim_grade', 'feed_pb', 'kex_eff', 'sipx_eff', 'air_flow', 'level')} / 100.0 - 0.85) * 0.5), 6) AS flow_rate
FROM sg"""))
def scenario_grid(spark, sf):
    x = S.scenario_steps(points(spark, sf))
    return x.select("seq", "cand_id", "step", F.round("kex_eff", 6).alias("kex_eff"), F.round("sipx_eff", 6).alias("sipx_eff"),
                    "sim_grade", "sim_recovery", F.round("flow_rate", 6).alias("flow_rate"))


def _fmt1(x):
    return f"printf('%.1f', {O.rhu(x, 1)})"


def _opt_msgs_sql():
    imp_tol = "0.005 * (1.0 + process_variability)"
    kex_tol = "1.5 * greatest(0.5, least(2.0, current_kex / 50.0))"
    sipx_tol = "0.8 * greatest(0.5, least(2.0, current_sipx / 30.0))"
    adj = "((current_avg_concentrate - 25.0) / 25.0)"
    pmin = f"CASE WHEN current_avg_concentrate > 0 THEN greatest(10.0, 15.0 + {adj} * 5.0) ELSE 15.0 END"
    pmax = f"CASE WHEN current_avg_concentrate > 0 THEN least(40.0, 35.0 + {adj} * 5.0) ELSE 35.0 END"
    kd, sd = "(optimal_kex - current_kex)", "(optimal_sipx - current_sipx)"
    optimal = (f"(recovery_improvement <= {imp_tol} AND abs({kd}) <= {kex_tol} AND abs({sd}) <= {sipx_tol} "
               f"AND current_avg_concentrate >= {pmin} AND current_avg_concentrate <= {pmax})")
    first = (f"CASE WHEN recovery_improvement > 0.01 THEN 'Optimization found ' || {_fmt1('recovery_improvement * 100.0')} "
             f"|| '% potential recovery improvement' ELSE 'Current settings are near optimal' END")
    kx = (f"CASE WHEN abs({kd}) > 2.0 THEN (CASE WHEN {kd} > 0 THEN 'Increase' ELSE 'Decrease' END) || ' KEX flow rate from ' "
          f"|| {_fmt1('current_kex')} || ' to ' || {_fmt1('optimal_kex')} || ' L/min' END")
    sx = (f"CASE WHEN abs({sd}) > 1.0 THEN (CASE WHEN {sd} > 0 THEN 'Increase' ELSE 'Decrease' END) || ' SIPX flow rate from ' "
          f"|| {_fmt1('current_sipx')} || ' to ' || {_fmt1('optimal_sipx')} || ' L/min' END")
    outc = (f"'Expected outcomes: ' || {_fmt1('optimal_avg_recovery * 100.0')} || '% recovery, ' "
            f"|| {_fmt1('optimal_avg_concentrate')} || '% Pb concentrate'")
    return (f"CASE WHEN {optimal} THEN ['{RC.MSG_TARGETS}'] "
            f"ELSE list_filter([{first}, {kx}, {sx}, {outc}], lambda m: m IS NOT NULL) END")


RECS = f"recs AS MATERIALIZED (SELECT seq, current_kex, current_sipx, {_opt_msgs_sql()} AS msgs FROM best)"


def _recs(spark, sf):
    b = S.best_scenario(points(spark, sf))
    msgs = RC.optimization_messages(F.col("current_kex"), F.col("current_sipx"), F.col("optimal_kex"), F.col("optimal_sipx"),
                                    F.col("recovery_improvement"), F.col("process_variability"),
                                    F.col("current_avg_concentrate"), F.col("optimal_avg_recovery"),
                                    F.col("optimal_avg_concentrate"))
    return b.select("seq", "current_kex", "current_sipx", msgs.alias("msgs"))


@query("recommendations", O.with_ctes(*SCEN, BEST, RECS, body="""
SELECT seq, len(msgs) AS n_msgs, array_to_string(msgs, ' | ') AS recommendations, to_json(msgs) AS recommendations_json FROM recs"""))
def recommendations(spark, sf):
    r = _recs(spark, sf)
    return r.select("seq", F.size("msgs").cast("bigint").alias("n_msgs"), F.array_join("msgs", " | ").alias("recommendations"),
                    RC.to_json_list(F.col("msgs")).alias("recommendations_json"))


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


def _filled(tpl, *args):
    parts = tpl.split("%s")
    out = _lit(parts[0].replace("%%", "%"))
    for a, p in zip(args, parts[1:]):
        out += f" || {a} || {_lit(p.replace('%%', '%'))}"
    return out


def svc_sql():
    M = RC.SERVICE_MSGS
    lit, fmt = _lit, _filled
    rec = "(recovery * 100.0)"
    items = [f"CASE WHEN grade < 15.0 THEN {fmt(M['pb_low'], _fmt1('grade'), lit('15.0'))} "
             f"WHEN grade > 35.0 THEN {fmt(M['pb_high'], _fmt1('grade'), lit('35.0'))} END",
             f"CASE WHEN {rec} < 75.0 THEN {fmt(M['rec_low'], _fmt1(rec))} WHEN {rec} > 95.0 THEN {fmt(M['rec_high'], _fmt1(rec))} END"]
    vals = {"kex": "coalesce(kex, 45.0)", "sipx": "coalesce(sipx, 25.0)", "air": "150.0", "ph": "11.0", "feed": "2.5"}
    for key, v in vals.items():
        lo, hi = RC.SERVICE_LIMITS[key]
        items.append(f"CASE WHEN {v} < {lo} THEN {lit(M[key + '_low'])} WHEN {v} > {hi} THEN {lit(M[key + '_high'])} END")
    arr = f"list_filter([{', '.join(items)}], lambda m: m IS NOT NULL)"
    return f"CASE WHEN len({arr}) = 0 THEN [{lit(M['ok'])}] ELSE {arr} END"


@query("recommendations_service", O.with_ctes(R, FIN, KFIN, body=f"""
SELECT seq, array_to_string({svc_sql()}, ' | ') AS recommendations FROM kfin"""))
def recommendations_service(spark, sf):
    k = kfin(spark, sf)
    return k.select("seq", F.array_join(RC.service_messages(F.col("grade"), F.col("recovery"), F.col("kex"), F.col("sipx")),
                                        " | ").alias("recommendations"))


def _status_sql():
    texts = {k: "[" + ", ".join(map(_lit, v)) + "]" for k, v in RC.STATUS_MSGS.items()}
    base = f"CASE status WHEN 'critical' THEN {texts['critical']} WHEN 'warning' THEN {texts['warning']} ELSE {texts['optimal']} END"
    measure = {"grade": "grade", "recovery": "(recovery * 100.0)"}
    extra = [f"CASE WHEN status = '{st}' AND {measure[m]} < {lo} THEN {_lit(low)} WHEN status = '{st}' AND {measure[m]} > {hi} THEN {_lit(high)} END"
             for (st, m), (lo, low, hi, high) in RC.STATUS_VALUE_MSGS.items()]
    return f"list_concat({base}, list_filter([{', '.join(extra)}], lambda m: m IS NOT NULL))"


@query("status_recommendations", O.with_ctes(R, FIN, KFIN, f"""
st AS (SELECT *, {O.status_reagent('grade', 'recovery * 100.0', 'kex', 'sipx')} AS status FROM kfin)""", body=f"""
SELECT seq, status, array_to_string({_status_sql()}, ' | ') AS recommendations FROM st"""))
def status_recommendations(spark, sf):
    """texts that the status of a reading calls for."""
    k = kfin(spark, sf).withColumn("status", P.status_reagent("grade", F.col("recovery") * 100.0, "kex", "sipx"))
    return k.select("seq", "status", F.array_join(RC.status_messages(F.col("status"), F.col("grade"), F.col("recovery") * 100.0),
                                                  " | ").alias("recommendations"))


@query("simulation_series", O.with_ctes(R, FIN, KFIN, PC, f"""
st AS (SELECT pc.*, s.step,
              CASE WHEN s.step < 3 THEN coalesce(kex, 45.0) * (1 - (s.step + 1) / 3.0::DOUBLE) + ck * ((s.step + 1) / 3.0::DOUBLE) ELSE ck END AS kex_eff,
              CASE WHEN s.step < 3 THEN coalesce(sipx, 25.0) * (1 - (s.step + 1) / 3.0::DOUBLE) + cs * ((s.step + 1) / 3.0::DOUBLE) ELSE cs END AS sipx_eff
       FROM pc, (SELECT range AS step FROM range(6)) s)""", f"""
sg AS (SELECT *, {O.grade('feed_pb', 'kex_eff', 'sipx_eff', 'air_flow', 'level')} AS sim_grade FROM st)""", body=f"""
SELECT seq, step, strftime(ts + step * INTERVAL {S.STEP_MINUTES} MINUTE, '%H:%M') AS time_label, sim_grade AS current_concentrate,
       round({O.recovery_pct('sim_grade', 'feed_pb', 'kex_eff', 'sipx_eff', 'air_flow', 'level')}, 6) AS current_recovery FROM sg"""))
def simulation_series(spark, sf):
    """the plotted series of the current setting, labelled HH:mm."""
    x = S.scenario_steps(points(spark, sf)).filter(F.col("cand_id") == 0)
    at = F.col("ts") + F.make_dt_interval(mins=F.col("step") * S.STEP_MINUTES)
    return x.select("seq", "step", RC.time_label(at).alias("time_label"), F.col("sim_grade").alias("current_concentrate"),
                    F.round(F.col("sim_recovery") * 100.0, 6).alias("current_recovery"))


PARSED = """
parsed AS (
  SELECT seq, idx - 1 AS idx, rec, current_kex, current_sipx,
    rec LIKE '%TARGETS ACHIEVED%' AS is_target,
    NOT (rec LIKE '%TARGETS ACHIEVED%') AND (lower(rec) LIKE '%increase%' OR lower(rec) LIKE '%decrease%') AS is_opt,
    lower(rec) LIKE '%increase%' AS is_inc,
    TRY_CAST(regexp_extract(rec, 'from ([\\d.]+) to ([\\d.]+)', 1) AS DOUBLE) AS frm,
    TRY_CAST(regexp_extract(rec, 'from ([\\d.]+) to ([\\d.]+)', 2) AS DOUBLE) AS tov
  FROM (SELECT seq, current_kex, current_sipx, unnest(msgs) AS rec, generate_subscripts(msgs, 1) AS idx FROM recs)),
p2 AS (
  SELECT *, NOT is_target AND NOT is_opt AND rec LIKE '%WARNING:%' AS is_warn,
         NOT is_target AND NOT is_opt AND NOT rec LIKE '%WARNING:%' AND rec LIKE '%Expected outcomes:%' AS is_outc,
         NOT is_target AND NOT is_opt AND NOT rec LIKE '%WARNING:%' AND NOT rec LIKE '%Expected outcomes:%'
           AND rec LIKE '%Current settings are near optimal%' AS is_near,
         CASE WHEN is_opt AND rec LIKE '%KEX%' THEN 'Pb_Conditioner_KEX_Flowrate'
              WHEN is_opt AND rec LIKE '%SIPX%' THEN 'Pb_Rougher1_SIPX_Flowrate' ELSE 'System_Status' END AS parameter
  FROM parsed),
p3 AS (
  SELECT seq, idx, rec,
    CASE WHEN is_target THEN 'success' WHEN is_opt THEN 'optimization' WHEN is_warn THEN 'warning' WHEN is_outc THEN 'info'
         WHEN is_near THEN 'success' ELSE 'info' END AS type,
    CASE WHEN is_opt THEN (CASE WHEN is_inc THEN 'increase' ELSE 'decrease' END) ELSE 'info' END AS action,
    CASE WHEN is_target OR is_opt THEN 'high' WHEN is_warn OR is_near THEN 'medium' WHEN is_outc THEN 'low' ELSE 'medium' END AS impact,
    CASE WHEN is_target THEN 1.0 WHEN is_opt THEN 0.8 WHEN is_warn THEN 0.7 WHEN is_outc THEN 0.8 WHEN is_near THEN 0.9 ELSE 0.8 END AS confidence,
    parameter,
    CASE WHEN is_target THEN 'TARGETS ACHIEVED'
         WHEN is_opt AND parameter = 'Pb_Conditioner_KEX_Flowrate' THEN (CASE WHEN is_inc THEN 'Increase KEX to Meet Target' ELSE 'Decrease KEX for Efficiency' END)
         WHEN is_opt AND parameter = 'Pb_Rougher1_SIPX_Flowrate' THEN (CASE WHEN is_inc THEN 'Increase SIPX Flow Rate' ELSE 'Decrease SIPX for Efficiency' END)
         WHEN is_warn THEN 'System Warning' WHEN is_outc THEN 'Expected Outcomes' WHEN is_near THEN 'System Optimal' ELSE rec END AS title,
    coalesce(nullif(CASE WHEN is_opt AND parameter <> 'System_Status' THEN frm END, 0),
             nullif(CASE parameter WHEN 'Pb_Conditioner_KEX_Flowrate' THEN current_kex WHEN 'Pb_Rougher1_SIPX_Flowrate' THEN current_sipx ELSE 0.0 END, 0), 0.0) AS current_value,
    coalesce(nullif(CASE WHEN is_opt AND parameter <> 'System_Status' THEN tov END, 0),
             nullif(CASE parameter WHEN 'Pb_Conditioner_KEX_Flowrate' THEN current_kex WHEN 'Pb_Rougher1_SIPX_Flowrate' THEN current_sipx ELSE 0.0 END, 0), 0.0) AS suggested_value
  FROM p2)"""


def _parsed(spark, sf):
    r = _recs(spark, sf)
    x = r.select("seq", "current_kex", "current_sipx",
                 F.posexplode(RC.from_json_list(RC.to_json_list(F.col("msgs")))).alias("idx", "rec"))
    p = RC.parse_message(F.col("rec"), F.col("current_kex"), F.col("current_sipx"))
    return x.select("seq", F.col("idx").cast("bigint").alias("idx"), "rec", p.alias("p")).select("seq", "idx", "rec", "p.*")


@query("parse_recs", O.with_ctes(*SCEN, BEST, RECS, PARSED, body="""
SELECT seq, idx, rec, type, action, impact, confidence, parameter, title, round(current_value, 6) AS current_value,
       round(suggested_value, 6) AS suggested_value FROM p3"""))
def parse_recs(spark, sf):
    return r6(_parsed(spark, sf))


@query("top_recs", O.with_ctes(*SCEN, BEST, RECS, PARSED, body="""
SELECT seq, idx, grp, action, title FROM (
  SELECT *, CASE WHEN action <> 'info' THEN 'actionable' ELSE 'informational' END AS grp,
         row_number() OVER (PARTITION BY seq, action <> 'info' ORDER BY idx) AS rk FROM p3)
WHERE (grp = 'actionable' AND rk <= 4) OR (grp = 'informational' AND rk <= 3)"""))
def top_recs(spark, sf):
    from pyspark.sql import Window
    p = _parsed(spark, sf).withColumn("grp", F.when(F.col("action") != "info", "actionable").otherwise("informational"))
    rk = F.row_number().over(Window.partitionBy("seq", "grp").orderBy("idx"))
    return (p.withColumn("_rk", rk)
             .filter(((F.col("grp") == "actionable") & (F.col("_rk") <= 4)) | ((F.col("grp") == "informational") & (F.col("_rk") <= 3)))
             .select("seq", "idx", "grp", "action", "title"))


@query("control_steps", O.with_ctes(R, FIN, KFIN, """
a AS (SELECT seq, coalesce(kex, 0.0) AS k0, coalesce(sipx, 0.0) AS s0,
             CASE WHEN grade < 15.0 THEN 'increase' WHEN grade > 35.0 THEN 'decrease' ELSE 'maintain' END AS action,
             CASE WHEN air_flow > 12.0 THEN 'Pb_Rougher1_AirFlow' ELSE 'Pb_Concentrate' END AS parameter FROM kfin)""", body="""
SELECT seq, parameter, action,
  CASE WHEN parameter = 'Pb_Concentrate' AND action = 'increase' THEN least(k0 + 5.0, 80.0)
       WHEN parameter = 'Pb_Concentrate' AND action = 'decrease' THEN greatest(k0 - 5.0, 0.0)
       WHEN parameter = 'Pb_Rougher1_AirFlow' AND action = 'decrease' THEN greatest(k0 - 3.0, 30.0) ELSE k0 END AS new_kex,
  CASE WHEN parameter = 'Pb_Concentrate' AND action = 'increase' THEN least(s0 + 3.0, 50.0)
       WHEN parameter = 'Pb_Concentrate' AND action = 'decrease' THEN greatest(s0 - 3.0, 0.0)
       WHEN parameter = 'Pb_Rougher1_AirFlow' AND action = 'decrease' THEN greatest(s0 - 2.0, 15.0) ELSE s0 END AS new_sipx
FROM a"""))
def control_steps(spark, sf):
    k = kfin(spark, sf)
    action = F.when(F.col("grade") < 15.0, "increase").when(F.col("grade") > 35.0, "decrease").otherwise("maintain")
    param = F.when(F.col("air_flow") > 12.0, "Pb_Rougher1_AirFlow").otherwise("Pb_Concentrate")
    k = k.select("seq", "kex", "sipx", param.alias("parameter"), action.alias("action"))
    nk, ns = RC.control_step(F.col("parameter"), F.col("action"), F.col("kex"), F.col("sipx"))
    return k.select("seq", "parameter", "action", nk.alias("new_kex"), ns.alias("new_sipx"))


@query("reagent_band", O.with_ctes(R, FIN, KFIN, body=f"""
SELECT seq, {O.band()} AS band, round(15.0 + (grade - 10.0) * 2.0, 6) AS rescaled,
       round(CASE {O.band()} WHEN 'none' THEN {O.clamp('15.0 + (grade - 10.0) * 2.0', 0.5, 2.5)}
            WHEN 'low' THEN {O.clamp('15.0 + (grade - 10.0) * 2.0', 5.0, 15.0)}
            WHEN 'excess' THEN {O.clamp('15.0 + (grade - 10.0) * 2.0', 30.0, 40.0)}
            WHEN 'high' THEN {O.clamp('15.0 + (grade - 10.0) * 2.0', 25.0, 35.0)}
            ELSE {O.clamp('15.0 + (grade - 10.0) * 2.0', 15.0, 25.0)} END, 6) AS banded_grade
FROM kfin"""))
def reagent_band(spark, sf):
    k = kfin(spark, sf)
    band = P.reagent_band()
    resc = P.rescale_prediction(F.col("grade"))
    return k.select("seq", band.alias("band"), F.round(resc, 6).alias("rescaled"),
                    F.round(P.band_clamp(resc, "kex", "sipx", "grade"), 6).alias("banded_grade"))
