"""Process rules as Column expressions.

All of these build ``Column`` objects that run inside whole-stage codegen;
none of them is a Python UDF.  Inputs are Columns (or column names) so the same
rule serves batch jobs and streaming queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values that must equal the reference's (do not change) ----------
# Reagent bands derived from realistic ranges KEX 20-100 L/min, SIPX 10-50 L/min:
# 25th / 75th / 95th percentile of each range.
KEX_Q25, KEX_Q75, KEX_Q95 = 40.0, 80.0, 96.0
SIPX_Q25, SIPX_Q75, SIPX_Q95 = 20.0, 40.0, 48.0
# Defaults used when an input tag is absent (live-service constant set).
DEFAULT_FEED, DEFAULT_KEX, DEFAULT_SIPX, DEFAULT_AIR, DEFAULT_LEVEL = 1.47, 60.0, 30.0, 9.97, 39.01
# Tailings model base points: live-service set and training-mean set.
RECOVERY_BASES = {
    "service": {"kex": 60.0, "sipx": 30.0, "air": 9.97, "level": 39.01},
    "training": {"kex": 916.30, "sipx": 439.93, "air": 9.97, "level": 39.01},
}
# Grade estimate effect weights: kex/60*2.0, sipx/30*1.5, air/10*1.2, level/40*0.8,
# feed multiplier 8.0, clamp 10-35 (noise term of the reference dropped).
GRADE_CLAMP = (10.0, 35.0)
# Band clamps for (grade, recovery) by reagent band.
BAND_CLAMPS = {
    "none": ((0.5, 2.5), (0.0, 10.0)),
    "low": ((5.0, 15.0), (20.0, 50.0)),
    "excess": ((30.0, 40.0), (90.0, 98.0)),
    "high": ((25.0, 35.0), (80.0, 95.0)),
    "normal": ((15.0, 25.0), (75.0, 90.0)),
}
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, digits: int) -> Column:
    """Round with IEEE arithmetic only (floor(x*10^d + 0.5) / 10^d), so every
    engine gives bit-identical results; ties are vanishingly rare for sensor data."""
    scale = float(10 ** digits)
    return F.floor(_c(x) * scale + 0.5) / scale


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def grade_estimate(feed="feed_pb", kex="kex", sipx="sipx", air="air_flow", level="level") -> Column:
    """concentrate grade from feed grade and four reagent/cell effects."""
    feed, kex, sipx, air, level = (F.coalesce(_c(feed), F.lit(1.5)), F.coalesce(_c(kex), F.lit(60.0)),
                                   F.coalesce(_c(sipx), F.lit(30.0)), F.coalesce(_c(air), F.lit(10.0)),
                                   F.coalesce(_c(level), F.lit(40.0)))
    effects = (kex / 60.0) * 2.0 + (sipx / 30.0) * 1.5 + (air / 10.0) * 1.2 + (level / 40.0) * 0.8
    return round_half_up(clamp(feed * 8.0 * effects / 4.0, *GRADE_CLAMP), 2)


def band_case(kex, sipx, out: dict) -> Column:
    """One flat CASE over the reagent bands returning ``out[band]``.  Band
    dependent values (names, clamp bounds) are chosen directly from the two
    flows, never by comparing a nested band CASE, so generated code stays
    small enough for the JIT."""
    k, s = _c(kex), _c(sipx)
    return (F.when((k == 0) & (s == 0), out["none"])
            .when((k <= KEX_Q25) & (s <= SIPX_Q25), out["low"])
            .when((k >= KEX_Q95) | (s >= SIPX_Q95), out["excess"])
            .when((k > KEX_Q75) | (s > SIPX_Q75), out["high"])
            .otherwise(out["normal"]))


def reagent_band(kex="kex", sipx="sipx") -> Column:
    """none / low / excess / high / normal from the two reagent flows."""
    return band_case(kex, sipx, {b: F.lit(b) for b in BAND_CLAMPS})


def band_limits(kex, sipx, which: str) -> tuple[Column, Column]:
    """(lo, hi) of the band's grade (which='grade') or recovery range."""
    idx = 0 if which == "grade" else 1
    lo = band_case(kex, sipx, {b: F.lit(v[idx][0]) for b, v in BAND_CLAMPS.items()})
    hi = band_case(kex, sipx, {b: F.lit(v[idx][1]) for b, v in BAND_CLAMPS.items()})
    return lo, hi


def band_clamp(value, kex, sipx, which: str) -> Column:
    """Clamp ``value`` to the grade or recovery range of the reagent band of
    (kex, sipx); the value expression appears once."""
    lo, hi = band_limits(kex, sipx, which)
    return F.greatest(lo, F.least(hi, _c(value)))


def rescale_prediction(p) -> Column:
    """map a 10-15 model output onto the 15-35 range."""
    return F.lit(15.0) + (_c(p) - 10.0) * 2.0


def tailings_factor(x: Column, base: float, weight: float) -> Column:
    return clamp(F.lit(0.3) - (x - base) / base * weight, 0.2, 0.4)


def _recovery_inputs(feed, kex, sipx, air, level, variant: str):
    b = RECOVERY_BASES[variant]
    return (F.coalesce(_c(feed), F.lit(DEFAULT_FEED)), F.coalesce(_c(kex), F.lit(b["kex"])),
            F.coalesce(_c(sipx), F.lit(b["sipx"])), F.coalesce(_c(air), F.lit(DEFAULT_AIR)),
            F.coalesce(_c(level), F.lit(DEFAULT_LEVEL)))


def tailings_grade(feed="feed_pb", kex="kex", sipx="sipx", air="air_flow", level="level",
                   variant: str = "service") -> Column:
    """Tailings grade t = f * mean of the four clamped tailings factors."""
    b = RECOVERY_BASES[variant]
    f, k, s, a, lv = _recovery_inputs(feed, kex, sipx, air, level, variant)
    avg_factor = (tailings_factor(k, b["kex"], 0.1) + tailings_factor(s, b["sipx"], 0.08)
                  + tailings_factor(a, b["air"], 0.06) + tailings_factor(lv, b["level"], 0.04)) / 4.0
    return f * avg_factor


def recovery_two_product(grade="grade", feed="feed_pb", kex="kex", sipx="sipx", air="air_flow",
                         level="level", variant: str = "service", tailings=None) -> Column:
    """two-product recovery 100*(c/f)*(f-t)/(c-t) in percent.

    ``variant='service'``: band clamp by reagent band, rounded to 0.1, 80.0
    when the formula does not apply.  ``variant='training'``: training-mean
    base points, clamp 80-95, tailings forced to 0.8*c when c <= t.
    ``tailings``: a column already holding ``tailings_grade`` (see
    ``with_recovery``), so the formula refers to it instead of repeating it.
    """
    c = _c(grade)
    f, k, s, _a, _lv = _recovery_inputs(feed, kex, sipx, air, level, variant)
    t = tailings_grade(feed, kex, sipx, air, level, variant) if tailings is None else _c(tailings)
    raw = F.lit(100.0) * (c / f) * (f - t) / (c - t)
    valid = (f > 0) & (c > 0)
    if variant == "service":
        banded = band_clamp(raw, k, s, "recovery")
        return F.when(valid & (c > t), round_half_up(banded, 1)).otherwise(F.lit(80.0))
    t2 = c * 0.8
    forced = F.lit(100.0) * (c / f) * (f - t2) / (c - t2)
    return F.when(valid, clamp(F.when(c > t, raw).otherwise(forced), 80.0, 95.0))


def with_recovery(df: DataFrame, out: str, grade="grade", feed="feed_pb", kex="kex", sipx="sipx",
                  air="air_flow", level="level", variant: str = "service", divisor: float = 1.0) -> DataFrame:
    """Add F6 recovery (divided by ``divisor``, e.g. 100 for a fraction) as column ``out`` in two staged
    projections: the tailings grade first, then the formula referring to it.
    Catalyst keeps the stages apart (the tailings column is used three
    times), so each formula is compiled once."""
    staged = df.select("*", tailings_grade(feed, kex, sipx, air, level, variant).alias("_tailings"))
    rec = recovery_two_product(grade, feed, kex, sipx, air, level, variant, tailings="_tailings")
    if divisor != 1.0:
        rec = rec / divisor
    return staged.select(*[F.col(c) for c in df.columns], rec.alias(out))


def fallback_grade(feed="feed_pb", kex="kex", sipx="sipx") -> Column:
    """F8: grade used when no calculated value matched a reading."""
    f = F.coalesce(_c(feed), F.lit(2.0))
    k = F.coalesce(_c(kex), F.lit(60.0))
    s = F.coalesce(_c(sipx), F.lit(30.0))
    return round_half_up(clamp(f * (F.lit(1.0) + (k - 60.0) * 0.1 + (s - 30.0) * 0.05), 5.0, 40.0), 2)


def fallback_recovery(kex="kex", sipx="sipx") -> Column:
    """F8: recovery fraction used when no calculated value matched."""
    k = F.coalesce(_c(kex), F.lit(60.0))
    s = F.coalesce(_c(sipx), F.lit(30.0))
    return round_half_up(clamp(F.lit(0.7) + (k - 40.0) * 0.002 + (s - 20.0) * 0.001, 0.5, 0.95), 3)


def status_reagent(grade="grade", recovery="recovery_pct", kex="kex", sipx="sipx") -> Column:
    """F11 (reagent based): critical / warning / optimal."""
    k, s, g, r = _c(kex), _c(sipx), _c(grade), _c(recovery)
    return (F.when((k == 0) & (s == 0), "critical")
            .when((k >= KEX_Q95) | (s >= SIPX_Q95), "critical")
            .when((k <= KEX_Q25) & (s <= SIPX_Q25),
                  F.when((g < 3.0) | (r < 15.0), "critical").otherwise("warning"))
            .otherwise("optimal"))


def _band_status(v: Column, lo: float, hi: float) -> Column:
    return F.when(v < lo, "critical").when(v <= hi, "optimal").otherwise("warning")


def status_worst_of(grade="grade", recovery_frac="recovery", grade_band=(15.0, 35.0),
                    recovery_band=(75.0, 95.0)) -> Column:
    """F11 (two metrics, worst of): recovery given as a fraction."""
    gs = _band_status(_c(grade), *grade_band)
    rs = _band_status(_c(recovery_frac) * 100.0, *recovery_band)
    return (F.when((gs == "critical") | (rs == "critical"), "critical")
            .when((gs == "optimal") & (rs == "optimal"), "optimal")
            .otherwise("warning"))


def status_pct(value, lo, hi, crit: float = 0.20, warn: float = 0.0) -> Column:
    """F11 (+-20 % legacy when warn=0; 15 %/5 % realistic when crit=.15, warn=.05)."""
    v, lo, hi = _c(value), F.lit(lo) if not isinstance(lo, Column) else lo, F.lit(hi) if not isinstance(hi, Column) else hi
    return (F.when((v < lo * (1 - crit)) | (v > hi * (1 + crit)), "critical")
            .when((v < lo * (1 - warn)) | (v > hi * (1 + warn)), "warning")
            .otherwise("optimal"))


def status_in_range(value, lo, hi) -> Column:
    """F11 (control range): within [lo, hi] -> 'optimal' else 'warning'."""
    v = _c(value)
    return F.when((v >= lo) & (v <= hi), "optimal").otherwise("warning")


def status_value(value, lo: float, hi: float, known=None) -> Column:
    """F11 (value cut-offs): a known status stands; without one, below ``lo``
    is critical, ``hi`` and more a warning, and what is between optimal (a
    missing value, too)."""
    v = _c(value)
    by_value = F.when(v < lo, "critical").when(v >= hi, "warning").otherwise("optimal")
    if known is None:
        return by_value
    return F.when(_c(known).isin("critical", "warning", "optimal"), _c(known)).otherwise(by_value)


def input_confidence(kex="kex", sipx="sipx", air="air_flow", ph=None, history_rows=None) -> Column:
    """additive input-quality confidence, clamp 0.7-0.98, 3 decimals."""
    k = F.coalesce(_c(kex), F.lit(45.0))
    s = F.coalesce(_c(sipx), F.lit(25.0))
    a = F.coalesce(_c(air), F.lit(150.0))
    p = F.lit(11.0) if ph is None else F.coalesce(_c(ph), F.lit(11.0))
    conf = (F.lit(0.85)
            + F.when(k.between(30, 60), 0.05).otherwise(0.0)
            + F.when(s.between(15, 40), 0.05).otherwise(0.0)
            + F.when(a.between(100, 200), 0.03).otherwise(0.0)
            + F.when(p.between(9.5, 12.0), 0.02).otherwise(0.0))
    if history_rows is not None:
        conf = conf + F.when(_c(history_rows) >= 20, 0.05).otherwise(0.0)
    return round_half_up(clamp(conf, 0.7, 0.98), 3)
