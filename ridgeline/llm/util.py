"""Shared helpers: table access, written intermediate tables, row keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import ensure_checkpoint_dir

_TABLES: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package (Spark's own file distribution), so that
    workers import it and keep their tables from task to task."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), "ridgeline_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder named by ``spark.checkpoint.dir``
    and read it back: lineage ends there, a lost executor loses nothing, and
    the planner knows the table's size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[tuple[SparkSession, str]]:
    """The written tables so far; a caller may pass a part of them to ``release``."""
    return list(_TABLES)


def release(old: list[tuple[SparkSession, str]]) -> None:
    """Delete tables that only finished work has read."""
    for spark, path in old:
        _TABLES.remove((spark, path))
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its counted rows
    are at most ``rows``; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def body(docs: DataFrame, text: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(docs[text], F.lit(""))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only: other columns of the input, whatever their names,
    cannot clash with an operator's own."""
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), body(docs).alias("text"))
