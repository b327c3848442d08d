"""DuckDB twins of the registered queries (the correctness oracle).

Written independently in plain SQL over the driver's pre-registered tables;
the helpers below only build the shared CTEs (the ``readings`` mapping and the
process-rule expressions) as SQL text.
"""

from __future__ import annotations

READINGS = """
readings AS (
  SELECT event_id AS seq, user_id % 4 AS asset_id, ts,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE (50 + v % 201) / 100.0::DOUBLE END AS feed_pb,
    (k * 11) / 10.0::DOUBLE AS kex,
    CAST(v % 61 AS DOUBLE) AS sipx,
    (399 + (v * 7) % 1019) / 100.0::DOUBLE AS air_flow,
    CASE WHEN event_id % 211 = 0 THEN 'inf'::DOUBLE ELSE ((event_id * 13) % 866) / 10.0::DOUBLE END AS level
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
)"""


def rhu(x: str, d: int) -> str:
    """Half-up rounding in plain IEEE arithmetic (same as process.round_half_up)."""
    scale = float(10 ** d)
    return f"(floor(({x}) * {scale}::DOUBLE + 0.5) / {scale}::DOUBLE)"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"


def grade(feed="feed_pb", kex="kex", sipx="sipx", air="air_flow", level="level") -> str:
    inner = (f"coalesce({feed}, 1.5) * 8.0 * ((coalesce({kex}, 60.0) / 60.0) * 2.0 + (coalesce({sipx}, 30.0) / 30.0) * 1.5"
             f" + (coalesce({air}, 10.0) / 10.0) * 1.2 + (coalesce({level}, 40.0) / 40.0) * 0.8) / 4.0")
    return rhu(clamp(inner, 10.0, 35.0), 2)


def band(kex="kex", sipx="sipx") -> str:
    return (f"(CASE WHEN {kex} = 0 AND {sipx} = 0 THEN 'none' WHEN {kex} <= 40 AND {sipx} <= 20 THEN 'low' "
            f"WHEN {kex} >= 96 OR {sipx} >= 48 THEN 'excess' WHEN {kex} > 80 OR {sipx} > 40 THEN 'high' "
            f"ELSE 'normal' END)")


def recovery_pct(g="grade", feed="feed_pb", kex="kex", sipx="sipx", air="air_flow", level="level") -> str:
    f = f"coalesce({feed}, 1.47)"
    k, s = f"coalesce({kex}, 60.0)", f"coalesce({sipx}, 30.0)"
    a, lv = f"coalesce({air}, 9.97)", f"coalesce({level}, 39.01)"
    fac = (f"({clamp(f'0.3 - ({k} - 60.0) / 60.0 * 0.1', 0.2, 0.4)} + {clamp(f'0.3 - ({s} - 30.0) / 30.0 * 0.08', 0.2, 0.4)}"
           f" + {clamp(f'0.3 - ({a} - 9.97) / 9.97 * 0.06', 0.2, 0.4)} + {clamp(f'0.3 - ({lv} - 39.01) / 39.01 * 0.04', 0.2, 0.4)}) / 4.0")
    t = f"({f} * {fac})"
    raw = f"(100.0 * ({g} / {f}) * ({f} - {t}) / ({g} - {t}))"
    b = band(k, s)
    banded = (f"(CASE {b} WHEN 'none' THEN {clamp(raw, 0.0, 10.0)} WHEN 'low' THEN {clamp(raw, 20.0, 50.0)} "
              f"WHEN 'excess' THEN {clamp(raw, 90.0, 98.0)} WHEN 'high' THEN {clamp(raw, 80.0, 95.0)} "
              f"ELSE {clamp(raw, 75.0, 90.0)} END)")
    return f"(CASE WHEN {f} > 0 AND {g} > 0 AND {g} > {t} THEN {rhu(banded, 1)} ELSE 80.0::DOUBLE END)"


def status_reagent(g="grade", rpct="recovery_pct", kex="kex", sipx="sipx") -> str:
    return (f"(CASE WHEN {kex} = 0 AND {sipx} = 0 THEN 'critical' WHEN {kex} >= 96 OR {sipx} >= 48 THEN 'critical' "
            f"WHEN {kex} <= 40 AND {sipx} <= 20 THEN (CASE WHEN {g} < 3.0 OR {rpct} < 15.0 THEN 'critical' ELSE 'warning' END) "
            f"ELSE 'optimal' END)")


def cadence_rows(table: str, minutes: int) -> str:
    """Rows of ``table`` kept by a timed save: first (ts, seq) per asset and
    aligned ``minutes`` window."""
    return (f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY asset_id, "
            f"time_bucket(INTERVAL {minutes} MINUTE, ts) ORDER BY ts, seq) = 1)")


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


KPIS = f"""
kpis AS (
  SELECT *, {recovery_pct()} / 100.0 AS recovery FROM (
    SELECT *, {grade()} AS grade FROM readings) x
)"""
