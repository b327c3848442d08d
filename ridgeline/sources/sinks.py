"""Sinks and exports (S5-S8) and the monthly-file scan (S1, S4).  The layouts
of the append tables are in ``layouts.py``.

Writes go to parquet/CSV with Spark's writers: partitioned by day for the
append tables so retention (P10) and time-range reads prune whole folders.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ridgeline.operators.joins import retain
from ridgeline.session import reliable_checkpoint

# --- fixed values that must equal the reference's ---------------------------
# Long export rows: (column, parameter label, unit), in this order.
EXPORT_ROWS = [("grade", "Pb Concentrate", "%"), ("kex", "KEX Flowrate", "L/min"), ("sipx", "SIPX Flowrate", "L/min"),
               ("air_flow", "Air Flow", "m³/min"), ("level", "Level", "%"), ("feed_pb", "Feed Pb", "%")]
# ---------------------------------------------------------------------------


def scan_monthly(spark: SparkSession, directory: str, tag: str = "", schema=None) -> DataFrame:
    """The files, or folders of part files, in ``directory`` whose name
    contains ``tag`` and ends in ``.parquet`` (in any case of its letters),
    columns merged by name (missing -> null).  ``source_file`` is that name
    and ``file_no`` its place in name order, from 0 (names are months, so name
    order is month order)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(directory)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(n for n in (f.getPath().getName() for f in listed) if tag in n and n.lower().endswith(".parquet"))
    if not names:
        raise FileNotFoundError(f"no parquet file named *{tag}* in {directory}")
    r = spark.read.option("mergeSchema", "true")
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(*[os.path.join(directory, n) for n in names])
    steps = F.split(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "/")
    file = F.element_at(F.filter(steps, lambda s: s.isin(names)), -1)
    return df.select("*", file.alias("source_file")).withColumn(
        "file_no", F.array_position(F.array(*map(F.lit, names)), F.col("source_file")).cast("int") - 1)


def read_training_set(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A stored training set; refuses one that isn't there, or has no
    numeric ``target``."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no training set at {path}") from e
    if target not in df.columns:
        raise ValueError(f"target column {target} not found in {path}")
    if not isinstance(df.schema[target].dataType, NumericType):
        raise ValueError(f"target column {target} of {path} is not numeric")
    return df


def sink_parquet(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink that refuses to overwrite unless told."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header (one folder of part files); times keep
    their microseconds."""
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def export_long(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ("seq",)) -> DataFrame:
    """Long form Parameter / Value / Unit / Timestamp (missing -> 0).
    The label/unit table is a constant of the code: built as a literal map,
    no join needed."""
    stacked = F.inline(F.array(*[F.struct(F.lit(label).alias("Parameter"),
                                          F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("Value"),
                                          F.lit(unit).alias("Unit")) for c, label, unit in EXPORT_ROWS]))
    return df.select(*keys, stacked, F.col(ts).alias("Timestamp"))


def append_table(df: DataFrame, path: str) -> None:
    """Append partitioned by day (a stream stores its epochs with
    ``layouts.append_epoch``)."""
    df.write.mode("append").partitionBy("dt").parquet(path)


def overwrite_partitions(df: DataFrame, path: str) -> None:
    """P10 write-back: replace only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_folders(df)).parquet(path))


def _folders(df: DataFrame) -> list[str]:
    """Partition columns of an append table: its day, and its epoch if it has one."""
    return [c for c in ("dt", "epoch") if c in df.columns]


def apply_retention(spark: SparkSession, path: str, cutoff: datetime, ts: str = "timestamp") -> None:
    """P10: delete the rows of the append table at ``path`` older than ``cutoff``.

    Day folders that are wholly expired are dropped without reading them; only
    the day of the cut-off is rewritten, from a checkpoint in the shared
    folder, and those of its epochs that keep nothing are dropped.  Rows
    without a timestamp stay.  Running it again changes nothing, nor does it
    on a table without rows.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    days = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dt=*")
    if not days.getFileSystem(hadoop).globStatus(days):
        return
    edge, when = F.lit(cutoff.date()), F.lit(cutoff).cast("timestamp_ntz")
    table = spark.read.parquet(path)
    keys = _folders(table)
    expired = [f"dt={r.dt}" for r in table.filter(F.col("dt") < edge).select("dt").distinct().collect()]  # one value per day folder
    day = table.filter(F.col("dt") == edge)
    if not day.filter(F.col(ts) < when).isEmpty():
        kept = reliable_checkpoint(retain(day, when, ts))
        gone = day.select(*keys).distinct().join(kept.select(*keys).distinct(), keys, "left_anti").collect()  # one row per folder of the day
        if not kept.isEmpty():
            overwrite_partitions(kept, path)
        expired += ["/".join(f"{k}={r[k]}" for k in keys) for r in gone]
    for part in expired:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        folder.getFileSystem(hadoop).delete(folder, True)
    spark.catalog.refreshByPath(path)
