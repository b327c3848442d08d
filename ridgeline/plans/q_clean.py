"""Queries for sources, cleaning, filters, table summaries, top-k and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.operators import clean as C
from ridgeline.operators import tables_ops as TO
from ridgeline.plans import oracle as O
from ridgeline.plans.registry import query
from ridgeline.sources import tables as T

R = O.READINGS
TAGS = T.TAGS


def _fin(c):
    return f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END AS {c}"


FIN_TAGS = ", ".join(_fin(c) for c in TAGS)


@query("ts_discovery", """
SELECT TRY_CAST(CASE WHEN event_id % 50 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS ts,
       event_id AS seq, value
FROM events""")
def ts_discovery(spark, sf):
    e = T.load(spark, sf, "events")
    raw = e.select(F.col("event_id").alias("seq"),
                   F.when(F.col("event_id") % 50 == 0, F.lit("not a time"))
                    .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
                   "value", "event_type")
    return C.numeric_only(C.discover_timestamp(raw), keep=["ts"])


@query("numeric_only", "SELECT event_id, ts, user_id, value FROM events")
def numeric_only(spark, sf):
    return C.numeric_only(T.load(spark, sf, "events"), keep=["ts"])


@query("clean_inf", O.with_ctes(R, body=f"SELECT seq, asset_id, ts, {FIN_TAGS} FROM readings"))
def clean_inf(spark, sf):
    return C.inf_to_null(T.readings(spark, sf))


@query("drop_empty_cols", O.with_ctes(R, body=f"SELECT seq, asset_id, ts, {', '.join(TAGS)} FROM readings"))
def drop_empty_cols(spark, sf):
    r = T.readings(spark, sf).select("seq", "asset_id", "ts", *TAGS)
    return C.drop_empty_columns(r.withColumn("spare", F.lit(None).cast("double")))


_VALID = " AND ".join(f"{c} IS NOT NULL AND NOT isinf({c}) AND NOT isnan({c})" for c in TAGS)


@query("valid_rows", O.with_ctes(R, body=f"SELECT * FROM readings WHERE {_VALID}"))
def valid_rows(spark, sf):
    return C.valid_rows(T.readings(spark, sf), TAGS)


@query("leakage_guard", O.with_ctes(R, body="SELECT seq, asset_id, ts, feed_pb, kex, sipx, air_flow, level FROM readings"))
def leakage_guard(spark, sf):
    r = T.readings(spark, sf)
    wide = r.select("*", (F.col("feed_pb") * 2).alias("grade_15min_ahead"), F.col("kex").alias("prediction_kex"),
                    F.col("sipx").alias("target"), F.col("level").alias("level_shift_-1"),
                    F.col("air_flow").alias("Pb_Rougher_Conc_Pb"))
    return C.leakage_guard(wide, target="target")


@query("complete_cases", O.with_ctes(R, body="SELECT * FROM readings WHERE feed_pb IS NOT NULL AND kex IS NOT NULL "
                                            "AND sipx IS NOT NULL AND air_flow IS NOT NULL AND level IS NOT NULL"))
def complete_cases(spark, sf):
    return C.complete_cases(T.readings(spark, sf), TAGS)


@query("range_scan", O.with_ctes(R, body="""
SELECT * FROM readings WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"""))
def range_scan(spark, sf):
    return C.range_scan(T.readings(spark, sf), "2024-01-10 00:00:00", "2024-01-12 12:00:00")


@query("range_optional", O.with_ctes(R, body="""
SELECT * FROM readings WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-23 00:00:00'"""))
def range_optional(spark, sf):
    return C.range_optional(T.readings(spark, sf), start="2024-01-20 00:00:00", end="2024-01-22")


_VIOL = ", ".join(f"CASE WHEN NOT ({c} BETWEEN {lo} AND {hi}) THEN '{c}' END"
                  for c, (lo, hi) in C.PARAM_RANGES.items())


@query("validate_ranges", O.with_ctes(R, body=f"""
SELECT seq, asset_id, concat_ws(',', {_VIOL}) AS violations, concat_ws(',', {_VIOL}) = '' AS is_valid FROM readings"""))
def validate_ranges(spark, sf):
    v = C.validate_ranges(T.readings(spark, sf))
    return v.select("seq", "asset_id", F.array_join("violations", ",").alias("violations"), "is_valid")


CONTRACT = ["feed_pb", "kex", "sipx", "air_flow", "level_lag1", *C.TAG_DEFAULTS]
CONTRACT_DEFAULTS = {"feed_pb": 1.47, **C.TAG_DEFAULTS}
_ABSENT = ", ".join(f"{v}::DOUBLE AS {c}" for c, v in C.TAG_DEFAULTS.items() if c != "Pb_Rougher1_Valve")


@query("feature_contract", O.with_ctes(R, body=f"""
SELECT seq, coalesce(feed_pb, 1.47) AS feed_pb, kex, sipx, air_flow, 0.0::DOUBLE AS level_lag1,
       CASE WHEN isinf(level) THEN 65.0 ELSE level END AS Pb_Rougher1_Valve, {_ABSENT} FROM readings"""))
def feature_contract(spark, sf):
    """P11 with the 16 defaults of P14; one of the tags is fed, with gaps."""
    r = T.readings(spark, sf).withColumn("Pb_Rougher1_Valve", F.when(F.abs("level") < float("inf"), F.col("level")))
    out, _missing = C.feature_contract(r, CONTRACT, CONTRACT_DEFAULTS, keep=["seq"])
    return out


@query("normalise_grade", O.with_ctes(R, body="""
SELECT seq, greatest(0.0::DOUBLE, least(50.0::DOUBLE, CASE WHEN v > 0 AND v < 1 THEN v * 100.0 ELSE v END)) AS grade_pct
FROM (SELECT seq, coalesce(CASE WHEN seq % 3 = 0 THEN NULL ELSE feed_pb / 4.0 END, kex) AS v FROM readings) x"""))
def normalise_grade(spark, sf):
    r = T.readings(spark, sf)
    actual = F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("feed_pb") / 4.0)
    return r.select("seq", C.normalise_grade(actual, F.col("kex")).alias("grade_pct"))


@query("cast_defaults", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k_text,
       coalesce(TRY_CAST(event_type AS INTEGER), -1) AS event_type,
       coalesce(TRY_CAST(CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0.0) AS value_text
FROM events""")
def cast_defaults(spark, sf):
    e = T.load(spark, sf, "events")
    raw = e.select("event_id", F.get_json_object("props", "$.k").alias("k_text"), "event_type",
                   F.when(F.col("event_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
                    .alias("value_text"))
    return C.cast_defaults(raw, {"k_text": ("int", 0), "event_type": ("int", -1), "value_text": ("double", 0.0)})


DUP = """
dup AS (SELECT * FROM readings UNION ALL
        SELECT seq + 1000000 AS seq, asset_id, ts, feed_pb, kex + 1 AS kex, sipx, air_flow, level
        FROM readings WHERE seq % 10 = 0)"""


@query("dedupe_last", O.with_ctes(R, DUP, body="""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, ts ORDER BY seq DESC) AS rn FROM dup) WHERE rn = 1"""))
def dedupe_last(spark, sf):
    return C.dedupe_last(T.readings_dup(T.readings(spark, sf)))


@query("impute_median", O.with_ctes(R, f"fin AS (SELECT seq, asset_id, ts, {FIN_TAGS} FROM readings)", body="""
SELECT seq, asset_id, ts, coalesce(feed_pb, (SELECT quantile_cont(feed_pb, 0.5) FROM fin)) AS feed_pb,
       coalesce(kex, (SELECT quantile_cont(kex, 0.5) FROM fin)) AS kex,
       coalesce(sipx, (SELECT quantile_cont(sipx, 0.5) FROM fin)) AS sipx,
       coalesce(air_flow, (SELECT quantile_cont(air_flow, 0.5) FROM fin)) AS air_flow,
       coalesce(level, (SELECT quantile_cont(level, 0.5) FROM fin)) AS level FROM fin"""))
def impute_median(spark, sf):
    return C.impute_median(C.inf_to_null(T.readings(spark, sf)), TAGS)


CALC = f"""
calc AS (SELECT seq, ts, asset_id, grade, {O.recovery_pct()} / 100.0 AS recovery
         FROM (SELECT *, {O.grade()} AS grade FROM {O.cadence_rows('readings', T.CALC_MINUTES)} c) x)"""
SETTINGS = f"settings AS (SELECT asset_id, ts, seq, kex, sipx FROM {O.cadence_rows('readings', T.SETTINGS_MINUTES)} s)"
PREDS = f"""
preds AS (SELECT seq, asset_id, ts, h AS horizon,
                 grade + (seq % 7 - 3) / 10.0::DOUBLE + h / 100.0::DOUBLE AS prediction,
                 ts + to_minutes(h) AS target_ts, grade AS issue_value
          FROM (SELECT *, {O.grade()} AS grade FROM readings) x,
               (SELECT unnest([5, 15, 30, 60]) AS h) hz)"""


@query("target_profile", O.with_ctes(R, CALC, body="""
SELECT asset_id, round(avg(grade), 6) AS mean, round(stddev_samp(grade), 6) AS std, min(grade) AS min, max(grade) AS max,
       count(*) FILTER (WHERE grade IS NULL) AS n_null, count(*) AS n FROM calc GROUP BY asset_id"""))
def target_profile(spark, sf):
    p = TO.target_profile(T.calc(T.readings(spark, sf)), "grade", ["asset_id"])
    return p.select("asset_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                    "min", "max", "n_null", "n")


def _four(spark, sf):
    r = T.readings(spark, sf)
    return {"sensor": r, "calculated": T.calc(r), "optimization": T.settings(r), "predictions": T.preds(r)}


@query("table_stats", O.with_ctes(R, CALC, SETTINGS, PREDS, body="""
SELECT 'sensor' AS table_name, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM readings
UNION ALL SELECT 'calculated', count(*), min(ts), max(ts) FROM calc
UNION ALL SELECT 'optimization', count(*), min(ts), max(ts) FROM settings
UNION ALL SELECT 'predictions', count(*), min(ts), max(ts) FROM preds"""))
def table_stats(spark, sf):
    return TO.table_stats(_four(spark, sf))


@query("latest_per_table", O.with_ctes(R, CALC, SETTINGS, PREDS, body="""
SELECT 'sensor' AS table_name, ts, seq FROM (SELECT * FROM readings ORDER BY ts DESC, seq DESC LIMIT 1)
UNION ALL SELECT 'calculated', ts, seq FROM (SELECT * FROM calc ORDER BY ts DESC, seq DESC LIMIT 1)
UNION ALL SELECT 'optimization', ts, seq FROM (SELECT * FROM settings ORDER BY ts DESC, seq DESC LIMIT 1)
UNION ALL SELECT 'predictions', ts, seq FROM (SELECT * FROM preds ORDER BY ts DESC, seq DESC LIMIT 1)"""))
def latest_per_table(spark, sf):
    return TO.latest_record(_four(spark, sf))


AS_OF = "2024-01-30 23:58:30"


def _fresh_sql(name, tbl, k):
    since = f"(date_diff('microsecond', max(ts), TIMESTAMP '{AS_OF}') / 60000000.0)"
    return (f"SELECT '{name}' AS table_name, CAST({k} AS BIGINT) AS interval_minutes, max(ts) AS last_ts, "
            f"{O.rhu(since, 2)} AS minutes_since_last_save, "
            f"{O.rhu(f'greatest(0.0::DOUBLE, {k}.0 - {since})', 2)} AS minutes_until_next_save, "
            f"{since} >= {k} AS ready_to_save FROM {tbl}")


@query("freshness", O.with_ctes(R, CALC, SETTINGS, body=" UNION ALL ".join(
    _fresh_sql(n, t, k) for n, t, k in (("sensor", "readings", 2), ("calculated", "calc", 5), ("optimization", "settings", 10)))))
def freshness(spark, sf):
    tabs = _four(spark, sf)
    tabs.pop("predictions")
    return TO.freshness(tabs, F.lit(AS_OF).cast("timestamp_ntz"))


@query("latest_n", O.with_ctes(R, body="SELECT * FROM readings ORDER BY ts DESC, seq DESC LIMIT 100"))
def latest_n(spark, sf):
    return TO.latest_n(T.readings(spark, sf), 100)


@query("latest_in_range", O.with_ctes(R, body="""
SELECT * FROM readings WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-08 00:00:00'
ORDER BY ts DESC, seq DESC LIMIT 50"""))
def latest_in_range(spark, sf):
    return TO.latest_in_range(T.readings(spark, sf), "2024-01-05 00:00:00", "2024-01-07", 50)


@query("preset_range", O.with_ctes(R, body="""
SELECT r.* FROM readings r JOIN (SELECT asset_id, max(ts) AS last FROM readings GROUP BY asset_id) m USING (asset_id)
WHERE r.ts >= m.last - INTERVAL 24 HOUR"""))
def preset_range(spark, sf):
    return TO.preset_range(T.readings(spark, sf), "24h", keys=["asset_id"])


@query("sample_n")
def sample_n(spark, sf):
    return TO.sample_n(T.readings(spark, sf), 500)


@query("union_unify", O.with_ctes(R, body="""
SELECT *, NULL::DOUBLE AS spare FROM readings WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
UNION ALL
SELECT seq, asset_id, ts, feed_pb, kex, sipx, air_flow, NULL::DOUBLE AS level, NULL::DOUBLE AS spare
FROM readings WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'"""))
def union_unify(spark, sf):
    return TO.union_unify(list(T.readings_months(T.readings(spark, sf))))
