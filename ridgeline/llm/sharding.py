"""Operator 10 [native]: shards by extendible hashing.

A document's address is a string of hash bits.  The directory maps address
prefixes to shards; a shard over the byte limit splits on its next bit, others
stay as they are.  One round looks at ``STEP`` more bits: byte sums of the
prefixes (combined before the shuffle) give every split of those bits at once.
Only rows of shards that are still too large enter the next round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import util

LIMIT_BYTES = 4_000_000
STEP = 10
#: Bits of the document key; rows that share them go on with those of their row number.
KEY_BITS, ROW_BITS = 32, 63


def _bits(n: int, number: Column) -> Column:
    return F.lpad(F.bin(number), n, "0")


def addresses(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row (numbered here if not given), doc_id, n_bytes, bits: written once, without texts."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    rows = util.written(docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), docs["doc_id"].cast("bigint").alias("doc_id"),
                                    F.octet_length(util.body(docs)).cast("bigint").alias("n_bytes")))
    more = F.shiftrightunsigned(F.xxhash64("row"), 1)
    return rows.withColumn("bits", F.concat(_bits(KEY_BITS, key), _bits(ROW_BITS, more)))


def directory(open_rows: DataFrame, depth: int, step: int, limit: int) -> DataFrame:
    """prefix (depth + step bits) -> shard, depth, shard_bytes, shard_docs, for
    the prefixes that fit within ``step`` more bits."""
    cells = open_rows.groupBy(F.substring("bits", 1, depth + step).alias("prefix")).agg(
        F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    cells = util.written(cells)
    at = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth + (depth > 0)), F.lit(depth + step))))
    at = at.withColumn("shard", F.col("prefix").substr(F.lit(1), F.col("depth")))
    sums = at.groupBy("shard", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    first = F.struct("depth", "shard", "shard_bytes", "shard_docs")
    return util.written(at.select("prefix", "shard", "depth").join(fits, ["shard", "depth"])
                        .groupBy("prefix").agg(F.min(first).alias("at")).select("prefix", "at.*"))


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, step: int = STEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, shard (its address prefix), depth,
    n_bytes, shard_bytes, shard_docs.

    Each shard holds at most ``limit`` bytes of UTF-8, or one document that is
    larger.  Null texts have 0 bytes; null doc_ids hash as the empty string;
    rows that share a doc_id are told apart by further bits when their shard
    is too large; an empty table gives no rows; other columns are ignored.
    """
    return _split(addresses(docs), limit, step).drop("row")


def _split(rows: DataFrame, limit: int, step: int) -> DataFrame:
    """The rows of ``addresses`` with their shards."""
    depth, done = 0, []
    cols = ["row", "doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs"]
    while True:
        here = rows.withColumn("prefix", F.substring("bits", 1, depth + step))
        found = directory(rows, depth, step, limit)
        looked = util.written(here.join(found, "prefix", "left").drop("prefix"))
        done.append(looked.filter("shard is not null").select(*cols))
        rows = looked.filter("shard is null").select("row", "doc_id", "n_bytes", "bits")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        depth += step


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, step: int = STEP) -> str:
    """Write every row of ``docs``, with all its columns, into one folder per
    shard (as ``shards`` has them) and return the name of the folders' key:
    "shard", with underscores after it if ``docs`` has such a column.  If all
    rows fit in one shard, whose address is empty, it is Spark's folder for that."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return free(name + "_") if name in taken else name

    number, key = free("row"), free("shard")
    kept = util.written(docs.withColumn(number, F.monotonically_increasing_id()))
    at = _split(addresses(kept, kept[number]), limit, step).select(F.col("row").alias(number), F.col("shard").alias(key))
    kept.join(at, number).drop(number).repartition(key).write.partitionBy(key).parquet(path)
    return key
