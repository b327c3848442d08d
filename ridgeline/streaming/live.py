"""Structured Streaming half (S9, ST1-ST6).

The live feed is a file stream of event files; every per-row rule is the
same Column function the batch path uses, so batch and stream agree by
construction.  Event time is ``ts`` cast to TIMESTAMP (watermarks need it;
the session clock is UTC).  Queries run with ``availableNow`` in tests and
with a processing-time trigger (4 s, the reference's tick) in service.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.functions import recs as RC
from ridgeline.operators import clean as C
from ridgeline.operators import joins as J
from ridgeline.operators import plugins as PL
from ridgeline.operators import predictions as PR
from ridgeline.plans.halo import DEFAULT_CHUNK_ROWS, row_windowed
from ridgeline.session import ensure_checkpoint_dir
from ridgeline.sources import tables as T

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TICK = "4 seconds"
RING = 100
# Minutes between the saves of sensor, calculated and optimisation rows.
CADENCES = (2, 5, 10)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def live_readings(spark: SparkSession, directory: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of readings from event files landing in ``directory``."""
    ev = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events*.parquet")
               .option("maxFilesPerTrigger", files_per_trigger).parquet(directory))
    return T.readings_from_events(ev).withColumn("ts", F.col("ts").cast("timestamp"))


def enrich(readings: DataFrame, analyser: PL.StatusAnalyser | None = None) -> DataFrame:
    """ST1: reading -> clean -> grade -> recovery -> status -> messages
    (stateless projection; identical Columns to the batch path).  An
    ``analyser`` (X3) takes the place of the status and message rules."""
    k = T.with_kpis(C.inf_to_null(readings))
    if analyser is not None:
        return PL.analysed(k, analyser).select("seq", "asset_id", "ts", "grade", "recovery", "status", "in_range", P.input_confidence().alias("confidence"),
                                               F.array_join("recommendations", " | ").alias("recommendations"))
    return k.select("seq", "asset_id", "ts", "grade", "recovery",
                    P.status_reagent("grade", F.col("recovery") * 100.0, "kex", "sipx").alias("status"),
                    P.input_confidence().alias("confidence"),
                    F.array_join(RC.service_messages(F.col("grade"), F.col("recovery"), F.col("kex"), F.col("sipx")),
                                 " | ").alias("recommendations"))


def snapshots(readings: DataFrame, minutes: int = 2, delay: str = "10 minutes") -> DataFrame:
    """ST2: first reading of each aligned k-minute window per asset; a window
    is emitted once the watermark passes its end (append mode)."""
    return (readings.withWatermark("ts", delay)
                    .groupBy("asset_id", F.window("ts", f"{minutes} minutes"))
                    .agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq"), F.count(F.lit(1)).alias("n_points"))
                    .select(F.lit(minutes).alias("cadence_minutes"), "asset_id",
                            F.col("window.start").cast("timestamp_ntz").alias("window_start"), "seq", "n_points"))


def _w4_lags(w) -> list[Column]:
    return [F.coalesce(F.lag(c, k).over(w), F.col(c)).alias(f"{c}_lag{k}") for c in ("kex", "sipx") for k in (1, 2)]


def ring_epoch(batch: DataFrame, epoch: int, folder: str, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> None:
    """ST3, one micro-batch: lag1/lag2 of kex and sipx (first rows: the current
    value, W4) over the carried buffer followed by the batch, and the buffer of
    the last ``RING`` readings per asset for the next one.

    The batch's rows are dealt over (asset, chunk), so an asset with most rows
    is many tasks.  Buffers alternate between two folders and the result goes
    to the epoch's own, so a batch that is run again reads what it read before
    and replaces what it wrote."""
    spark = batch.sparkSession
    new = batch.select("asset_id", "seq", "ts", "kex", "sipx", F.lit(1).alias("_new"), F.lit(0).alias("_place"))
    rows = new if epoch == 0 else new.unionByName(spark.read.parquet(f"{folder}/buffer/{(epoch - 1) % 2}"))
    order = ["_new", "_place", "ts", "seq"]
    lags = row_windowed(rows, ["asset_id"], order, _w4_lags, lookback=2, chunk_rows=chunk_rows)
    lags.filter("_new = 1").select("seq", *[f"{c}_lag{k}" for c in ("kex", "sipx") for k in (1, 2)]).write.mode("overwrite").parquet(f"{folder}/lags/epoch={epoch}")
    last = Window.partitionBy("asset_id").orderBy(*[F.desc(c) for c in order])
    kept = rows.withColumn("_place", F.row_number().over(last)).filter(F.col("_place") <= RING)
    (kept.select("asset_id", "seq", "ts", "kex", "sipx", F.lit(0).alias("_new"), (-F.col("_place")).alias("_place"))
         .write.mode("overwrite").parquet(f"{folder}/buffer/{epoch % 2}"))


def _epochs(readings: DataFrame, work, folder: str) -> None:
    """Run ``work(batch, epoch)`` on every micro-batch of what is there now."""
    q = (readings.writeStream.foreachBatch(work).option("checkpointLocation", folder + "-ckpt")
                 .trigger(availableNow=True).start())
    q.awaitTermination()


def ring_lags(readings: DataFrame, name: str = "ring") -> str:
    """ST3 over a stream; returns the folder of the lags, one part per epoch."""
    folder = scratch(readings.sparkSession, name)
    _epochs(readings, lambda batch, epoch: ring_epoch(batch, epoch, folder), folder)
    return f"{folder}/lags"


def rule_alerts(readings: DataFrame) -> DataFrame:
    """ST4: alert catalogue as a constant CASE chain over unpivoted metrics
    (no join, no aggregation: valid in append mode), deduplicated by alert id
    within the watermark so replayed readings do not alert twice."""
    k = T.with_kpis(C.inf_to_null(readings))
    metrics = J.kpi_metrics()
    long = k.select("seq", "asset_id", "ts", F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])))
    long = long.filter(F.col("value").isNotNull())
    hit = None
    for m, _p, lo, hi, sev, typ, _rec, dec in sorted(J.ALERT_RULES, key=lambda r: (r[0], r[1])):
        cond = (F.col("metric") == m) & (F.col("value") > lo) & (F.col("value") < hi)
        val = F.struct(F.lit(sev).alias("severity"), F.lit(typ).alias("alert_type"), F.lit(dec).alias("decimals"))
        hit = F.when(cond, val) if hit is None else hit.when(cond, val)
    mid = F.lit(0)
    for name, i in J.METRIC_IDS.items():
        mid = F.when(F.col("metric") == name, F.lit(i)).otherwise(mid)
    a = long.select("seq", "asset_id", "ts", "metric", "value", hit.alias("r"), (F.col("seq") * 10 + mid).alias("alert_id"))
    a = a.filter(F.col("r").isNotNull()).select("alert_id", "seq", "asset_id", "ts", "metric", "value",
                                                 "r.severity", "r.alert_type")
    return a.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["alert_id"])


def bursts(readings: DataFrame, seconds: int = 60, slide: int = 10, threshold: int = 2,
           delay: str = "10 minutes") -> DataFrame:
    """ST5: sliding-window reading count per asset and breach flag."""
    return (readings.withWatermark("ts", delay)
                    .groupBy("asset_id", F.window("ts", f"{seconds} seconds", f"{slide} seconds"))
                    .agg(F.count(F.lit(1)).alias("n"))
                    .select("asset_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n",
                            (F.col("n") >= threshold).alias("breach")))


def run_to_parquet(df: DataFrame, name: str, output_mode: str = "append", available_now: bool = True) -> str:
    """Run a streaming query into a fresh parquet folder (exactly-once file
    sink with its own checkpoint); returns the folder."""
    spark = df.sparkSession
    out = scratch(spark, name)
    w = (df.writeStream.format("parquet").outputMode(output_mode)
           .option("checkpointLocation", out + "-ckpt").option("path", out))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=TICK)
    q = w.start()
    q.awaitTermination()
    return out


def drift_epoch(batch: DataFrame, epoch: int, folder: str) -> None:
    """ST6, one micro-batch of predictions: the log and the drift parts
    of this epoch.  A batch that is run again replaces both."""
    p = T.preds(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    p.write.mode("overwrite").parquet(f"{folder}/log/epoch={epoch}")
    PR.drift_parts(p).write.mode("overwrite").parquet(f"{folder}/drift/epoch={epoch}")


def drift_monitor(readings: DataFrame, name: str = "drift") -> str:
    """ST6: prediction log and drift parts, one part per epoch; returns their
    folder.  ``drift_table`` merges the parts, a few rows per epoch, so the log
    is never read again."""
    folder = scratch(readings.sparkSession, name)
    _epochs(readings, lambda batch, epoch: drift_epoch(batch, epoch, folder), folder)
    return folder


def drift_table(spark: SparkSession, folder: str) -> DataFrame:
    return PR.merged_drift(spark.read.parquet(f"{folder}/drift"))


def validated(batch: DataFrame, epoch: int, folder: str, minutes: int = 5, delay: int = 10) -> DataFrame:
    """ST6, one micro-batch: predictions joined with the actual grades that
    arrive when they fall due (interval join), where one of the two is new.

    The batch and the readings carried from earlier ones meet in a merge join
    of the batch engine, which deals out by time and spills; a stream-stream
    join holds its state in memory and steps through it row by row.  As with a watermark ``delay``
    minutes behind, a prediction or actual whose time lies behind the newest
    reading of the epochs before the last is late and left out, and a reading
    is carried until its longest horizon, ``minutes`` and ``delay`` have passed.
    State alternates between two folders, so a batch that is run again reads
    what it read before."""
    spark, old, now = batch.sparkSession, f"{folder}/state/{(epoch - 1) % 2}", f"{folder}/state/{epoch % 2}"
    newest, before = (0, 0) if epoch == 0 else spark.read.parquet(f"{old}/newest").first()
    mark = lambda ms: F.timestamp_millis(F.lit(max(0, ms - delay * 60_000)))
    batch.withColumn("_late", mark(before)).write.mode("overwrite").parquet(f"{now}/new")  # the feed is parsed once
    parts = [spark.read.parquet(f"{now}/new")]
    seen = parts[0].agg(F.max(F.unix_millis("ts"))).first()[0]
    spark.range(1).select(F.lit(max(newest, seen or 0)).cast("long").alias("newest"), F.lit(newest).cast("long").alias("before")).write.mode("overwrite").parquet(f"{now}/newest")
    if epoch:
        reach = F.make_dt_interval(mins=F.lit(max(T.HORIZONS) + minutes))
        kept = [spark.read.parquet(f"{old}/{x}") for x in ("new", "carried")[:epoch]]
        reduce(DataFrame.unionByName, kept).filter(F.col("ts") > mark(before) - reach).write.mode("overwrite").parquet(f"{now}/carried")
        parts.append(spark.read.parquet(f"{now}/carried"))
    preds = [T.preds(r, ("_late",)).filter(F.col("target_ts") > F.col("_late")).drop("ts", "_late").hint("merge") for r in parts]
    actuals = [r.filter(F.col("ts") > F.col("_late")).select("asset_id", "ts", P.grade_estimate().alias("actual")) for r in parts]
    pairs = PR.due_pairs(preds[0], reduce(DataFrame.unionByName, actuals), minutes)
    if epoch:
        pairs = pairs.unionByName(PR.due_pairs(preds[1], actuals[0], minutes))
    return pairs.select("seq", "asset_id", "horizon", "target_ts", "actual_ts", "prediction", "actual")


def accuracy_epoch(pairs: DataFrame, epoch: int, folder: str) -> None:
    """ST6, one micro-batch of validated predictions: pairs and accuracy sums
    (A14) of this epoch.  A batch that is run again replaces both.  The sums
    are taken from the written pairs, so these are made once and not cached;
    the pairs of a prediction stand together, which zstd packs best."""
    path = f"{folder}/pairs/epoch={epoch}"
    pairs.write.mode("overwrite").option("compression", "zstd").parquet(path)
    PR.accuracy_parts(pairs.sparkSession.read.schema(pairs.schema).parquet(path), ["horizon"]).write.mode("overwrite").parquet(f"{folder}/accuracy/epoch={epoch}")


def accuracy_monitor(readings: DataFrame, name: str = "accuracy") -> str:
    """ST6: validated pairs and accuracy sums, one part per epoch; returns their folder."""
    folder = scratch(readings.sparkSession, name)
    _epochs(readings, lambda batch, epoch: accuracy_epoch(validated(batch, epoch, folder), epoch, folder), folder)
    return folder


def accuracy_table(spark: SparkSession, folder: str) -> DataFrame:
    return PR.merged_accuracy(spark.read.parquet(f"{folder}/accuracy"), ["horizon"])
