"""Halo chunks: ordered window work on very long series without one hot task.

``Window.partitionBy(asset_id)`` puts every row of an asset into one task; with
few assets (or one asset holding a third of the data) that task is the whole
job.  Instead rows get a global position in (keys, order) order, are cut into
fixed-size chunks of ``chunk_rows`` positions, and the last ``lookback`` rows of
each chunk are copied into the next one (``lookahead`` rows of the next chunk
into the previous one for lead-style features).  Window functions then run per
(keys, chunk): a task never holds more than ``chunk_rows + lookback +
lookahead`` rows, and results equal the global per-key window exactly.

Global positions come from a range-partitioned sort (balanced by sampling on
the full sort key, which is unique) plus per-partition offsets: the offsets
table has one row per partition (a proven size bound), so it is broadcast.
The sorted, positioned data is checkpointed to the shared checkpoint folder so
both uses of it (counts and rows) see one materialisation and lineage stays
short when an executor is lost.

Time-range windows use the same idea with time buckets (``time_chunks``):
rows within ``lookback`` of a bucket's end are copied into the next bucket.
Their frames are found by binary search in the chunk's sorted times, as a
sliding range frame of Spark costs every row the whole length of its frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ridgeline.operators.windows import RangeFrames
from ridgeline.session import reliable_checkpoint, ship_package

DEFAULT_CHUNK_ROWS = 1 << 20
_LOW33 = (1 << 33) - 1


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def global_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                     partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Add ``_gpos``: 0-based position of each row in (keys, order) order."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = _cols([*keys, *order])
    s = (df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
           .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        s = reliable_checkpoint(s)
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = counts.select(
        F.col("_pid").alias("_opid"),
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    out = (s.join(F.broadcast(offsets), F.col("_pid") == F.col("_opid"))
             .withColumn("_gpos", F.col("_off") + F.col("_pos"))
             .drop("_mid", "_pid", "_pos", "_opid", "_off"))
    return out


def chunked(df_pos: DataFrame, chunk_rows: int, lookback: int, lookahead: int = 0) -> DataFrame:
    """Assign ``_chunk`` and append halo copies flagged ``_halo``."""
    if lookback > chunk_rows or lookahead > chunk_rows:
        raise ValueError("halo larger than a chunk: raise chunk_rows")
    B = F.lit(chunk_rows)
    chunk = F.floor(F.col("_gpos") / B)
    off = F.col("_gpos") % B
    parts = [df_pos.withColumn("_chunk", chunk).withColumn("_halo", F.lit(False))]
    if lookback > 0:
        parts.append(df_pos.filter(off >= chunk_rows - lookback)
                     .withColumn("_chunk", chunk + 1).withColumn("_halo", F.lit(True)))
    if lookahead > 0:
        parts.append(df_pos.filter(off < lookahead)
                     .withColumn("_chunk", chunk - 1).withColumn("_halo", F.lit(True)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


def row_windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 build: Callable[[object], list[Column]], lookback: int, lookahead: int = 0,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS, partitions: int | None = None,
                 checkpoint: bool = True) -> DataFrame:
    """Run row-frame window features ``build(w)`` per key in (order) order.

    ``build`` receives the WindowSpec to use and returns named Columns; frames
    must not look further back than ``lookback`` rows or further ahead than
    ``lookahead`` rows.  Output: the input columns plus the built ones.
    """
    base_cols = df.columns
    pos = global_positions(df, keys, order, partitions, checkpoint)
    u = chunked(pos, chunk_rows, lookback, lookahead)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_gpos")
    return (u.select(*base_cols, "_halo", *build(w))
             .filter(~F.col("_halo")).drop("_halo"))


def time_chunks(df_pos: DataFrame, keys: Sequence[str], chunk_rows: int, lookback_seconds: int,
                lookahead_seconds: int = 0) -> DataFrame:
    """Chunks of ``chunk_rows`` positions with halo copies by time: adds
    ``_chunk`` and ``_halo`` to rows that have ``_gpos`` and the microsecond
    epoch ``_us``.

    A row is copied into a later chunk of its key that begins within
    ``lookback_seconds`` after it, and into an earlier one that ends within
    ``lookahead_seconds`` before it (rows of equal time always), so range
    frames per (key, chunk) equal the global ones however dense the rows are.
    The chunks that a chunk's rows may reach come from a table with two rows
    per (key, chunk), its first and last time."""
    back, ahead = lookback_seconds * 1_000_000, lookahead_seconds * 1_000_000
    d = df_pos.withColumn("_chunk", F.floor(F.col("_gpos") / F.lit(chunk_rows)))
    ends = d.groupBy(*keys, "_chunk").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    marks = ends.select(*keys, "_chunk", F.inline(F.array(F.struct(F.lit(True).alias("_starts"), F.col("_first").alias("_at")),
                                                          F.struct(F.lit(False).alias("_starts"), F.col("_last").alias("_at")))))
    w = Window.partitionBy(*keys).orderBy("_at")
    mark = F.struct(F.col("_chunk").alias("c"), F.col("_at").alias("at"))
    later = F.collect_list(F.when(F.col("_starts"), mark)).over(w.rangeBetween(0, back))
    earlier = F.collect_list(F.when(~F.col("_starts"), mark)).over(w.rangeBetween(-ahead, 0))
    near = (marks.select(*keys, "_chunk", "_starts", F.when(F.col("_starts"), earlier).otherwise(later).alias("_near"))
                 .groupBy(*keys, "_chunk").agg(
                     F.first(F.when(F.col("_starts"), F.col("_near")), ignorenulls=True).alias("_earlier"),
                     F.first(F.when(~F.col("_starts"), F.col("_near")), ignorenulls=True).alias("_later"))
                 .select(*keys, "_chunk", F.filter("_earlier", lambda m: m["c"] < F.col("_chunk")).alias("_earlier"),
                         F.filter("_later", lambda m: m["c"] > F.col("_chunk")).alias("_later"))
                 .filter((F.size("_earlier") > 0) | (F.size("_later") > 0))
                 .select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_chunk").alias("_of_chunk"), "_earlier", "_later"))
    match = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_chunk") == F.col("_of_chunk")]
    reached = F.concat(F.filter("_earlier", lambda m: m["at"] >= F.col("_us") - ahead), F.filter("_later", lambda m: m["at"] <= F.col("_us") + back))
    halo = (d.join(near, match).select(*[c for c in d.columns if c != "_chunk"], F.explode(F.transform(reached, lambda m: m["c"])).alias("_chunk"))
             .withColumn("_halo", F.lit(True)))
    return d.withColumn("_halo", F.lit(False)).unionByName(halo)


def range_frames(chunk: pa.Table, asked: dict[tuple, str], order: Sequence[str]) -> pa.Table:
    """The rows of one (key, chunk) that are no halo copies, with a column for
    every frame that is ``asked`` for.  Rows without a time are each other's frame."""
    chunk = chunk.take(pc.sort_indices(chunk, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
    own = np.flatnonzero(~chunk["_halo"].to_numpy())
    untimed, us = chunk["_us"].null_count, chunk["_us"].combine_chunks().drop_null().to_numpy()
    at, out = us[np.maximum(own - untimed, 0)] if len(us) else np.zeros(len(own), np.int64), chunk.take(pa.array(own))
    for (fn, c, lo, hi), name in asked.items():
        start = np.where(own < untimed, 0, untimed + np.searchsorted(us, at + lo, "left"))
        end = np.where(own < untimed, untimed, untimed + np.searchsorted(us, at + hi, "right"))
        row = start if fn == "first" else end - 1
        out = out.append_column(name, pa.array(end - start, pa.int64()) if fn == "count" else chunk[c].take(pa.array(row, mask=start >= end)))
    return out


def time_windowed(df: DataFrame, keys: Sequence[str], ts: str, build: Callable[[object], list[Column]],
                  lookback_seconds: int, lookahead_seconds: int = 0, chunk_rows: int = DEFAULT_CHUNK_ROWS,
                  tiebreak: Sequence[str] = (), partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Range-frame window features per key, evaluated per chunk with a time halo.

    ``build(w)`` gets the ``RangeFrames`` of a window by key, ordered by the
    microsecond epoch, and returns named Columns.  A task holds ``chunk_rows``
    rows of one key and what their frames reach, never a whole key or day, and
    finds a frame in time that doesn't depend on how many rows it covers.
    """
    base_cols = df.columns
    pos = global_positions(df.withColumn("_us", epoch_micros(ts)), keys, ["_us", *tiebreak], partitions, checkpoint)
    u = time_chunks(pos, keys, chunk_rows, lookback_seconds, lookahead_seconds)
    frames = RangeFrames()
    built, asked, order = build(frames), frames.asked, ["_us", *tiebreak]
    names = list(dict.fromkeys([*base_cols, *order]))
    made = [StructField(n, LongType() if fn == "count" else df.schema[c].dataType) for (fn, c, _, _), n in asked.items()]
    schema = StructType([*(u.schema[c] for c in base_cols), *made])
    ship_package(df.sparkSession)

    def run(chunk: pa.Table) -> pa.Table:
        return range_frames(chunk, asked, order).select(schema.names)

    return (u.select(*keys, "_chunk", "_halo", *[c for c in names if c not in keys])
             .groupBy(*keys, "_chunk").applyInArrow(run, schema).select(*base_cols, *built))


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (TIMESTAMP_NTZ) column,
    independent of the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                 chunk_rows: int = DEFAULT_CHUNK_ROWS, backward_after: bool = False,
                 zero: bool = False, partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """W14 on the chunked plan: last non-null value so far per key.

    Pass 1 fills inside each (key, chunk); the carry from earlier chunks
    comes from a table with one row per (key, chunk) (``rows / chunk_rows``
    rows), windowed per key and joined back.  ``backward_after`` then fills
    the leading nulls of each key with its first non-null value (a per-key
    aggregate).  Output has the input columns with ``cols`` filled.
    """
    base_cols = df.columns
    pos = global_positions(df, keys, order, partitions, checkpoint)
    d = pos.withColumn("_chunk", F.floor(F.col("_gpos") / F.lit(chunk_rows)))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_gpos").rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_ff_{c}") for c in cols])
    tail = d.groupBy(*keys, "_chunk").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_gpos"))).alias(f"_t_{c}") for c in cols])
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tail.select(*keys, "_chunk", *[F.last(f"_t_{c}", ignorenulls=True).over(wc).alias(f"_c_{c}") for c in cols])
    j = local.join(carry, [*keys, "_chunk"], "left")
    out_cols = []
    for c in base_cols:
        if c in cols:
            v = F.coalesce(F.col(f"_ff_{c}"), F.col(f"_c_{c}"))
            out_cols.append(v.alias(c))
        else:
            out_cols.append(F.col(c))
    res = j.select(*out_cols)
    if backward_after:
        first = df.groupBy(*keys).agg(*[
            F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*[F.col(o) for o in order])))
             .alias(f"_b_{c}") for c in cols])
        res = res.join(first, list(keys), "left").select(
            *[F.coalesce(F.col(c), F.col(f"_b_{c}")).alias(c) if c in cols else F.col(c) for c in base_cols])
    if zero:
        res = res.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in base_cols])
    return res
