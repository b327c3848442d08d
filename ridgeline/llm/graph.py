"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import util


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, keep_centre: bool) -> DataFrame:
    """``pairs`` (u, v): every v goes to the smallest of u and its neighbours.
    Minima are combined before the shuffle; a node with very many neighbours is
    split by the skew join, since both sides of it are plain tables."""
    least = util.written(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    out = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_centre:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), two columns of one
    orderable type; root is the smallest node of the component.  Null ends and
    loops are ignored."""
    now = util.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = util.written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = util.written(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        now = util.written(_star(large, True))
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
