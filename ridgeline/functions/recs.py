"""Rule messages as arrays, their parsing and control steps.

Messages are built with ``when`` + ``format_string`` into an array and the
nulls filtered out: pure Column expressions, evaluated per row in codegen.
Numbers are rounded half-up with IEEE arithmetic before formatting so the
text does not depend on the formatter's tie rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.process import round_half_up

# --- fixed values that must equal the reference's ---------------------------
MSG_TARGETS = "TARGETS ACHIEVED - All parameters within optimal ranges"
MSG_IMPROVE = "Optimization found %s%% potential recovery improvement"
MSG_NEAR = "Current settings are near optimal"
MSG_CHANGE = "%s %s flow rate from %s to %s L/min"
MSG_OUTCOME = "Expected outcomes: %s%% recovery, %s%% Pb concentrate"
MSG_FAILED = "WARNING: Optimization failed. Using current settings."
SERVICE_MSGS = {
    "pb_low": "Pb concentrate (%s%%) is below minimum target (%s%%). Consider increasing KEX flow rate or adjusting feed grade.",
    "pb_high": "Pb concentrate (%s%%) is above target range (%s%%). Consider reducing KEX flow rate or adjusting pH.",
    "rec_low": "Recovery rate (%s%%) is below target (75-95%%). Check air flow rate and impeller speed.",
    "rec_high": "Recovery rate (%s%%) is above optimal range. Consider reducing air flow to improve concentrate grade.",
    "kex_low": "💡 KEX flow rate is low. Consider increasing to improve Pb recovery.",
    "kex_high": "💡 KEX flow rate is high. Consider reducing to improve concentrate grade.",
    "sipx_low": "💡 SIPX flow rate is low. Consider increasing to improve bubble stability.",
    "sipx_high": "💡 SIPX flow rate is high. Consider reducing to optimize froth characteristics.",
    "air_low": "💡 Air flow rate is low. Consider increasing to improve particle-bubble contact.",
    "air_high": "💡 Air flow rate is high. Consider reducing to improve concentrate grade.",
    "ph_low": "pH is low. Consider increasing to improve Pb selectivity.",
    "ph_high": "💡 pH is high. Consider reducing to optimize mineral recovery.",
    "feed_low": "💡 Feed Pb grade is low. Consider adjusting feed blend to improve concentrate grade.",
    "feed_high": "💡 Feed Pb grade is high. Monitor recovery rates and adjust reagents accordingly.",
    "ok": "Process parameters are within optimal ranges. Continue monitoring.",
}
SERVICE_LIMITS = {"rec": (75.0, 95.0), "kex": (35.0, 55.0), "sipx": (20.0, 35.0), "air": (120.0, 180.0),
                  "ph": (10.5, 11.5), "feed": (2.0, 3.5)}
# Status-driven texts: four per status, then one each where the grade or the
# recovery (%) lies below or above these values.
STATUS_MSGS = {
    "critical": ("Immediate intervention required - process outside safe limits", "Check KEX and SIPX reagent dosing systems",
                 "Verify Pb concentrate grade measurements", "Review feed Pb grade and characteristics"),
    "warning": ("Monitor process parameters closely - approaching limits", "Consider fine-tuning KEX and SIPX flow rates",
                "Check cell level and froth height stability", "Review air flow and bubble size distribution"),
    "optimal": ("Process operating within optimal ranges", "Continue current operating parameters",
                "Maintain regular monitoring schedule", "Excellent Pb concentrate grade and recovery achieved"),
}
STATUS_VALUE_MSGS = {  # (status, measure): (low, text below it, high, text above it)
    ("critical", "grade"): (15.0, "Increase collector (KEX) dosage to improve Pb recovery", 35.0, "Reduce collector dosage to prevent over-flotation"),
    ("critical", "recovery"): (80.0, "Optimize air flow and froth height for better recovery", 95.0, "Check for potential over-flotation conditions"),
    ("warning", "grade"): (18.0, "Slightly increase KEX dosage", 32.0, "Consider reducing KEX dosage"),
}
# Multi-horizon texts, target band (%), changes that are worth a text, least mean confidence.
MSG_MH_FAILED = "WARNING: Multi-horizon optimization failed. Using current settings."
MSG_MH_SCORE = "Multi-horizon optimization score: %s"
MSG_MH_IN, MSG_MH_OUT = "%smin: %s%% Pb (target range) - Confidence: %s%%", "%smin: %s%% Pb (outside target) - Confidence: %s%%"
MSG_MH_CHANGE = "%s %s from %s to %s L/min"
MSG_MH_LOW = "Low prediction confidence (%s%%) - consider manual verification"
MH_TARGET, MH_KEX_CHANGE, MH_SIPX_CHANGE, MH_LEAST_CONFIDENCE = (9.5, 11.5), 2.0, 1.0, 0.7
# F14 dynamic tolerances
IMPROVE_BASE, KEX_TOL, SIPX_TOL = 0.005, 1.5, 0.8
PB_BASE = (15.0, 35.0)
# F18 control steps: (kex step, kex clamp), (sipx step, sipx clamp)
STEP_UP = ((5.0, 80.0), (3.0, 50.0))
STEP_DOWN = ((5.0, 0.0), (3.0, 0.0))
AIR_DOWN = ((3.0, 30.0), (2.0, 15.0))
# F15 parameter names
PARAM_KEX, PARAM_SIPX, PARAM_NONE = "Pb_Conditioner_KEX_Flowrate", "Pb_Rougher1_SIPX_Flowrate", "System_Status"
# ---------------------------------------------------------------------------


def fmt1(x: Column) -> Column:
    return F.format_string("%.1f", round_half_up(x, 1))


def time_label(ts: Column) -> Column:
    """the HH:mm label of a time."""
    return F.date_format(ts, "HH:mm")


def _compact(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda m: m.isNotNull())


def optimization_messages(cur_kex, cur_sipx, opt_kex, opt_sipx, improvement, variability, current_pb,
                          opt_recovery, opt_conc) -> Column:
    """F13 (optimizer) with F14 tolerances and F22 number text.  Without an
    improvement the optimizer has failed, and says so."""
    kd, sd = opt_kex - cur_kex, opt_sipx - cur_sipx
    imp_tol = F.lit(IMPROVE_BASE) * (F.lit(1.0) + variability)
    kex_tol = F.lit(KEX_TOL) * F.greatest(F.lit(0.5), F.least(F.lit(2.0), cur_kex / 50.0))
    sipx_tol = F.lit(SIPX_TOL) * F.greatest(F.lit(0.5), F.least(F.lit(2.0), cur_sipx / 30.0))
    adj = (current_pb - 25.0) / 25.0
    pb_min = F.when(current_pb > 0, F.greatest(F.lit(10.0), PB_BASE[0] + adj * 5.0)).otherwise(F.lit(PB_BASE[0]))
    pb_max = F.when(current_pb > 0, F.least(F.lit(40.0), PB_BASE[1] + adj * 5.0)).otherwise(F.lit(PB_BASE[1]))
    optimal = ((improvement <= imp_tol) & (F.abs(kd) <= kex_tol) & (F.abs(sd) <= sipx_tol)
               & (current_pb >= pb_min) & (current_pb <= pb_max))

    def change(diff, name, cur, opt, thr):
        word = F.when(diff > 0, "Increase").otherwise("Decrease")
        return F.when(F.abs(diff) > thr, F.format_string(MSG_CHANGE, word, F.lit(name), fmt1(cur), fmt1(opt)))

    full = _compact([
        F.when(improvement > 0.01, F.format_string(MSG_IMPROVE, fmt1(improvement * 100.0))).otherwise(F.lit(MSG_NEAR)),
        change(kd, "KEX", cur_kex, opt_kex, 2.0),
        change(sd, "SIPX", cur_sipx, opt_sipx, 1.0),
        F.format_string(MSG_OUTCOME, fmt1(opt_recovery * 100.0), fmt1(opt_conc)),
    ])
    return F.when(improvement.isNull(), F.array(F.lit(MSG_FAILED))).when(optimal, F.array(F.lit(MSG_TARGETS))).otherwise(full)


def status_messages(status: Column, grade: Column, recovery_pct: Column) -> Column:
    """F13 (status driven): the texts of the status, then those that the grade
    and the recovery (%) add.  Any other status, a null one too, counts as
    optimal; a null measure as 0."""
    known = F.when(status.isin("critical", "warning"), status).otherwise("optimal")
    measures = {"grade": F.coalesce(grade, F.lit(0.0)), "recovery": F.coalesce(recovery_pct, F.lit(0.0))}
    base = F.when(known == "critical", F.array(*map(F.lit, STATUS_MSGS["critical"])))
    for name in ("warning", "optimal"):
        base = base.when(known == name, F.array(*map(F.lit, STATUS_MSGS[name])))
    extra = [F.when((known == name) & (measures[m] < lo), F.lit(low)).when((known == name) & (measures[m] > hi), F.lit(high))
             for (name, m), (lo, low, hi, high) in STATUS_VALUE_MSGS.items()]
    return F.concat(base, _compact(extra))


def multi_horizon_messages(score: Column, horizons: dict[int, tuple[Column, Column]], cur_kex: Column, cur_sipx: Column,
                           opt_kex: Column, opt_sipx: Column, target=MH_TARGET) -> Column:
    """F13 (multi-horizon): the score, one text per horizon from its predicted
    grade and the r2 of its model (in the order given; a horizon without both
    has none), the changes of reagents that are large enough, and a
    warning where the mean confidence is low (an r2 that is missing counts as
    0.8).  Without a score the search has failed."""
    def percent(x):
        return fmt1(x * 100.0)

    def change(name, cur, opt, least):
        word = F.when(opt > cur, "Increase").otherwise("Decrease")
        return F.when(F.abs(opt - cur) > least, F.format_string(MSG_MH_CHANGE, word, F.lit(name), fmt1(cur), fmt1(opt)))

    def horizon(h, p, r2):
        words = (F.lit(str(h)), fmt1(p), percent(r2))
        there = p.isNotNull() & r2.isNotNull()
        return F.when(there, F.when(p.between(*target), F.format_string(MSG_MH_IN, *words)).otherwise(F.format_string(MSG_MH_OUT, *words)))

    per_horizon = [horizon(h, p, r2) for h, (p, r2) in horizons.items()]
    mean = sum((F.coalesce(r2, F.lit(0.8)) for _, r2 in horizons.values()), F.lit(0.0)) / float(len(horizons))
    said = _compact([
        F.format_string(MSG_MH_SCORE, F.format_string("%.3f", round_half_up(score, 3))), *per_horizon,
        change("KEX", cur_kex, opt_kex, MH_KEX_CHANGE), change("SIPX", cur_sipx, opt_sipx, MH_SIPX_CHANGE),
        F.when(mean < MH_LEAST_CONFIDENCE, F.format_string(MSG_MH_LOW, percent(mean)))])
    return F.when(score.isNull(), F.array(F.lit(MSG_MH_FAILED))).otherwise(said)


def service_messages(grade, recovery_frac, kex, sipx, air=None, ph=None, feed=None, band=(15.0, 35.0)) -> Column:
    """F13 (live service): rule texts on grade, recovery, reagents, air, pH, feed."""
    M, L = SERVICE_MSGS, SERVICE_LIMITS
    rec = recovery_frac * 100.0
    kex = F.coalesce(kex, F.lit(45.0))
    sipx = F.coalesce(sipx, F.lit(25.0))
    air = F.lit(150.0) if air is None else F.coalesce(air, F.lit(150.0))
    ph = F.lit(11.0) if ph is None else F.coalesce(ph, F.lit(11.0))
    feed = F.lit(2.5) if feed is None else F.coalesce(feed, F.lit(2.5))
    lo, hi = band
    items = [
        F.when(grade < lo, F.format_string(M["pb_low"], fmt1(grade), F.lit(str(lo))))
         .when(grade > hi, F.format_string(M["pb_high"], fmt1(grade), F.lit(str(hi)))),
        F.when(rec < L["rec"][0], F.format_string(M["rec_low"], fmt1(rec)))
         .when(rec > L["rec"][1], F.format_string(M["rec_high"], fmt1(rec))),
    ]
    for key, v in (("kex", kex), ("sipx", sipx), ("air", air), ("ph", ph), ("feed", feed)):
        lo_, hi_ = L[key]
        items.append(F.when(v < lo_, F.lit(M[f"{key}_low"])).when(v > hi_, F.lit(M[f"{key}_high"])))
    msgs = _compact(items)
    return F.when(F.size(msgs) == 0, F.array(F.lit(M["ok"]))).otherwise(msgs)


def parse_message(rec: Column, cur_kex: Column, cur_sipx: Column) -> Column:
    """recommendation text -> struct(type, action, impact, confidence,
    parameter, title, current_value, suggested_value).  Titles follow the
    parsed action (the reference's title check is case-sensitive and never
    sees a capitalised 'Increase')."""
    low = F.lower(rec)
    is_target = rec.contains("TARGETS ACHIEVED")
    is_inc, is_dec = low.contains("increase"), low.contains("decrease")
    is_opt = ~is_target & (is_inc | is_dec)
    is_warn = ~is_target & ~is_opt & rec.contains("WARNING:")
    is_outc = ~is_target & ~is_opt & ~is_warn & rec.contains("Expected outcomes:")
    is_near = ~is_target & ~is_opt & ~is_warn & ~is_outc & rec.contains("Current settings are near optimal")
    typ = (F.when(is_target, "success").when(is_opt, "optimization").when(is_warn, "warning")
            .when(is_outc, "info").when(is_near, "success").otherwise("info"))
    action = F.when(is_opt, F.when(is_inc, "increase").otherwise("decrease")).otherwise("info")
    impact = (F.when(is_target | is_opt, "high").when(is_warn | is_near, "medium").when(is_outc, "low").otherwise("medium"))
    conf = (F.when(is_target, 1.0).when(is_opt, 0.8).when(is_warn, 0.7).when(is_outc, 0.8).when(is_near, 0.9)
             .otherwise(0.8))
    param = (F.when(is_opt & rec.contains("KEX"), PARAM_KEX).when(is_opt & rec.contains("SIPX"), PARAM_SIPX)
              .otherwise(PARAM_NONE))
    frm = F.regexp_extract(rec, r"from ([\d.]+) to ([\d.]+)", 1).try_cast("double")
    to = F.regexp_extract(rec, r"from ([\d.]+) to ([\d.]+)", 2).try_cast("double")
    has_nums = is_opt & (param != PARAM_NONE)
    current_param = F.when(param == PARAM_KEX, cur_kex).when(param == PARAM_SIPX, cur_sipx).otherwise(F.lit(0.0))
    title = (F.when(is_target, "TARGETS ACHIEVED")
              .when(is_opt & (param == PARAM_KEX), F.when(is_inc, "Increase KEX to Meet Target").otherwise("Decrease KEX for Efficiency"))
              .when(is_opt & (param == PARAM_SIPX), F.when(is_inc, "Increase SIPX Flow Rate").otherwise("Decrease SIPX for Efficiency"))
              .when(is_warn, "System Warning").when(is_outc, "Expected Outcomes").when(is_near, "System Optimal")
              .otherwise(rec))
    nz = lambda v: F.when(v.isNotNull() & (v != 0), v)  # noqa: E731  (JS `x || fallback`)
    cur_v = F.coalesce(nz(F.when(has_nums, frm)), nz(current_param), F.lit(0.0))
    sug_v = F.coalesce(nz(F.when(has_nums, to)), nz(current_param), F.lit(0.0))
    return F.struct(typ.alias("type"), action.alias("action"), impact.alias("impact"), F.lit(conf).alias("confidence"),
                    param.alias("parameter"), title.alias("title"), cur_v.alias("current_value"),
                    sug_v.alias("suggested_value"))


def control_step(parameter: Column, action: Column, cur_kex: Column, cur_sipx: Column) -> tuple[Column, Column]:
    """new (kex, sipx) for a recommendation: concentrate increase
    +5/+3 clamped 80/50, decrease -5/-3 floored at 0, air-flow decrease
    -3/-2 floored 30/15; other parameters keep the current values."""
    k0, s0 = F.coalesce(cur_kex, F.lit(0.0)), F.coalesce(cur_sipx, F.lit(0.0))
    conc = parameter == "Pb_Concentrate"
    air_dec = (parameter == "Pb_Rougher1_AirFlow") & (action == "decrease")
    kex = (F.when(conc & (action == "increase"), F.least(k0 + STEP_UP[0][0], F.lit(STEP_UP[0][1])))
            .when(conc & (action == "decrease"), F.greatest(k0 - STEP_DOWN[0][0], F.lit(STEP_DOWN[0][1])))
            .when(air_dec, F.greatest(k0 - AIR_DOWN[0][0], F.lit(AIR_DOWN[0][1]))).otherwise(k0))
    sipx = (F.when(conc & (action == "increase"), F.least(s0 + STEP_UP[1][0], F.lit(STEP_UP[1][1])))
             .when(conc & (action == "decrease"), F.greatest(s0 - STEP_DOWN[1][0], F.lit(STEP_DOWN[1][1])))
             .when(air_dec, F.greatest(s0 - AIR_DOWN[1][0], F.lit(AIR_DOWN[1][1]))).otherwise(s0))
    return kex, sipx


def to_json_list(arr: Column) -> Column:
    """F16: JSON text of a message list (the stored form)."""
    return F.to_json(arr)


def from_json_list(text: Column) -> Column:
    """F16: message list back from JSON text."""
    return F.from_json(text, "array<string>")
