"""Table access and the derived sensor views used by every query.

``readings`` maps the driver's ``events`` table onto a five-tag sensor frame
(FIXTURES.md section 3).  The mapping is a narrow projection (no shuffle), so
it costs one parquet scan with column pruning at any scale.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import process as P

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

TAGS = ["feed_pb", "kex", "sipx", "air_flow", "level"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def readings_from_events(events: DataFrame) -> DataFrame:
    """events -> readings(seq, asset_id, ts, feed_pb, kex, sipx, air_flow, level)."""
    v = F.round(F.col("value") * 100).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 4).alias("asset_id"),
        F.col("ts"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(50) + v % 201) / F.lit(100.0).cast("double")).alias("feed_pb"),
        ((k * 11) / F.lit(10.0).cast("double")).alias("kex"),
        (v % 61).cast("double").alias("sipx"),
        ((F.lit(399) + (v * 7) % 1019) / F.lit(100.0).cast("double")).alias("air_flow"),
        F.when(F.col("event_id") % 211 == 0, F.lit(float("inf")))
         .otherwise(((F.col("event_id") * 13) % 866) / F.lit(10.0).cast("double")).alias("level"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(load(spark, sf_dir, "events"))


def readings_dup(r: DataFrame) -> DataFrame:
    """readings plus a later copy (seq + 1e6, kex + 1) of every tenth row."""
    dup = (r.filter(F.col("seq") % 10 == 0)
            .withColumn("seq", F.col("seq") + 1_000_000)
            .withColumn("kex", F.col("kex") + 1.0))
    return r.unionByName(dup)


def readings_months(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and second half of January; the second drops ``level`` and gains
    an always-null ``spare`` column (schema drift between monthly files)."""
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    m1 = r.filter(F.col("ts") < cut)
    m2 = (r.filter(F.col("ts") >= cut).drop("level")
           .withColumn("spare", F.lit(None).cast("double")))
    return m1, m2


def with_kpis(r: DataFrame) -> DataFrame:
    """Add grade (F7) and recovery fraction (F6) computed from the tags."""
    g = r.select("*", P.grade_estimate().alias("grade"))
    return P.with_recovery(g, "recovery", grade="grade", divisor=100.0)


# Save cadence (minutes) of the reference's calculated-values
# and optimisation tables.
CALC_MINUTES = 5
SETTINGS_MINUTES = 10


def cadence_table(df: DataFrame, minutes: int, keys: tuple[str, ...] = ("asset_id",),
                  ts: str = "ts", tie: str = "seq") -> DataFrame:
    """The row a timed save keeps: first row (by ts, tie) of each aligned
    ``minutes`` window per key.  One hash aggregate with a map-side partial
    ``min_by``: a single row per (key, window) crosses the shuffle, and a hot
    key spreads over its windows."""
    cols = df.columns
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), F.col(tie)))
    return (df.groupBy(*keys, F.window(ts, f"{minutes} minutes").start.alias("_w"))
              .agg(first.alias("_r")).select("_r.*"))


def calc(r: DataFrame) -> DataFrame:
    """Calculated values table: grade and recovery of the reading saved at
    each 5-minute cadence point."""
    return (with_kpis(cadence_table(r, CALC_MINUTES))
            .select("seq", "ts", "asset_id", "grade", "recovery"))


HORIZONS = (5, 15, 30, 60)


def preds(r: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prediction log: every reading scored for every horizon; ``keep`` names
    further columns of the reading that its predictions keep."""
    hz = F.explode(F.array(*[F.lit(h) for h in HORIZONS]))
    base = (r.select("seq", "asset_id", "ts", P.grade_estimate().alias("grade"), *keep)
             .withColumn("horizon", hz))
    return base.select(
        "seq", "asset_id", "ts", "horizon",
        (F.col("grade") + (F.col("seq") % 7 - 3) / F.lit(10.0).cast("double")
         + F.col("horizon") / F.lit(100.0).cast("double")).alias("prediction"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("horizon"))).alias("target_ts"),
        F.col("grade").alias("issue_value"), *keep,
    )


def actuals(r: DataFrame) -> DataFrame:
    """Observed grade per calculated-values row: (asset_id, ts, actual)."""
    return calc(r).select("asset_id", "ts", F.col("grade").alias("actual"))


def settings(r: DataFrame) -> DataFrame:
    """Optimisation table: control settings saved at each 10-minute cadence point."""
    return cadence_table(r, SETTINGS_MINUTES).select("asset_id", "ts", "seq", "kex", "sipx")
