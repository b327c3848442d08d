"""Operator 3 [native]: exact duplicates by deterministic block naming.

A text without white space is cut into blocks of fixed size.  The distinct
blocks are sorted and numbered; a block's number is its name.  Then adjacent
names are paired, the distinct pairs are sorted and numbered, and so on until
one name is left of each document.  Names come from comparing texts, so equal
names mean equal texts.

The distinct blocks cross the network once, copies already combined on the map
side.  Their numbers travel back to the documents on a 128-bit routing key.
If a key stood for two texts, it would have two names; that is looked up, and
the keys are then made anew from another seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import util

BLOCK_BYTES = 4096
#: The characters that don't count, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _measured(docs: DataFrame, block_bytes: int) -> DataFrame:
    # numbered here, below the explode: there each row is still one document
    norm = util.texts(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("norm", normalised(F.col("text")))
    return norm.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block_bytes)).cast("int"))


def _cut(block_bytes: int, of_block) -> Column:
    """``of_block`` of every block of column ``norm``, in order."""
    return F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1),
                       lambda i: of_block(F.substring(F.col("norm").cast("binary"), i * block_bytes + 1, F.lit(block_bytes))))


def _key(seed: int, block: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block).alias("k1"), F.xxhash64(F.lit(~seed), block).alias("k2")]


def _name_blocks(docs: DataFrame, block_bytes: int) -> tuple[int, DataFrame]:
    """(seed, names k1, k2 -> name): the sorted distinct blocks, numbered."""
    seed = 0
    while True:
        blocks = _measured(docs, block_bytes).select(F.explode(_cut(block_bytes, lambda b: b)).alias("block"))
        names = util.written(blocks.select(*_key(seed, F.col("block")), "block").distinct().sortWithinPartitions("block")
                             .select("k1", "k2", F.monotonically_increasing_id().alias("name")))
        if names.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            return seed, names
        seed += 1


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_points, text_sha256, and the
    identity of its text (n_blocks, name)."""
    seed, names = _name_blocks(docs, block_bytes)
    keyed = (_measured(docs, block_bytes)
             .select("row", "doc_id", F.char_length("text").alias("n_points"),
                     F.sha2("norm", 256).alias("text_sha256"), "n_blocks",
                     F.posexplode(_cut(block_bytes, lambda b: F.struct(*_key(seed, b)))).alias("pos", "key"))
             .select("row", "n_blocks", "pos", "key.k1", "key.k2",
                     *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_points", "text_sha256")]))
    first = util.written(keyed.join(names, ["k1", "k2"]).drop("k1", "k2"))
    about = ["row", "doc_id", "n_points", "text_sha256", "n_blocks"]
    out = first.filter("n_blocks = 1").select(*about, "name")
    longest = first.agg(F.max("n_blocks")).first()[0] or 1
    level, width = first.filter("n_blocks > 1").select("row", "n_blocks", "pos", "name"), 1
    whole = None
    while width < longest:
        width *= 2
        pairs = util.written(
            level.groupBy("row", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")))
        names = util.written(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
                             .withColumn("name", F.monotonically_increasing_id()))
        named = util.written(pairs.join(names, ["a", "b"]).drop("a", "b"))
        done = named.filter(F.col("n_blocks") <= width).select("row", "name")
        whole = done if whole is None else whole.unionByName(done)
        level = named.filter(F.col("n_blocks") > width)
    if whole is not None:
        out = out.unionByName(first.filter("n_blocks > 1 and pos = 0").select(*about).join(whole, "row").select(*about, "name"))
    return out


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256.

    Of equal texts the row with the most code points stays, then the smallest
    doc_id (null last), then the first of repeated rows.  Null texts count as
    empty; empty texts are one group; other columns are ignored; an empty table
    gives no rows.
    """
    ident = util.written(identities(docs, block_bytes))
    best = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = util.written(ident.groupBy("n_blocks", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size")))
    return ident.join(groups, ["n_blocks", "name"]).select(
        ident["doc_id"], F.col("best.doc_id").alias("keep_id"), "group_size",
        (ident["row"] == F.col("best.row")).alias("kept"), "text_sha256")
