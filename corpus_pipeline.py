"""From raw documents to packed training sequences.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns the documents it keeps, or, as the last one, the packed pieces.
Each result is written as Parquet and read again as the next one's ``docs``.

Null texts count as empty: they are never toxic, equal each other, link with
nothing, hold no secret, and are packed as one end token.  Documents that share
a doc_id, or have none, are told apart by their texts; fully repeated rows stay
once.  Extra
columns of ``docs`` pass through, whatever their names.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import exact_dedup, jaccard, packing, secrets, toxicity, util
from ridgeline.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
_LAST: list = []


def _stage(work):
    """Deletes the working tables of the stage before, whose result is written."""
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        util.ship(spark)
        util.release(_LAST)
        before = util.tables()
        out = work(spark, docs, sf_dir)
        _LAST[:] = [t for t in util.tables() if t not in before]
        return out
    return run


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` (with its key columns named as in ``gone``, null-safe) that ``gone`` doesn't list."""
    match = [docs[c].eqNullSafe(gone["_gone" + c]) for c in docs.columns if "_gone" + c in gone.columns]
    return docs.join(util.bounded(gone), functools.reduce(lambda a, b: a & b, match), "left_anti")


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, util.load(spark, sf_dir, "labels"))
    return docs.filter(~toxicity.is_toxic(docs["text"], model))


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    flags = util.written(exact_dedup.exact_duplicates(docs).groupBy("doc_id", "text_sha256")
                         .agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    digest, place = _free(docs, "digest"), _free(docs, "place")
    keyed = docs.withColumn(digest, F.sha2(exact_dedup.normalised(util.body(docs)), 256))
    key = [F.col("doc_id").alias("_gonedoc_id"), F.col("text_sha256").alias("_gone" + digest)]
    out = _without(keyed, util.written(flags.filter(~F.col("kept")).select(*key)))
    again = util.written(flags.filter(F.col("kept") & (F.col("n") > 1)).select(*key))
    if not again.isEmpty():  # rows repeated as they are, or one doc_id with equal texts
        same = out["doc_id"].eqNullSafe(again["_gonedoc_id"]) & (out[digest] == again["_gone" + digest])
        longest = Window.partitionBy("doc_id", digest).orderBy(F.desc(F.char_length("text")), F.xxhash64("text"))
        once = out.join(again, same, "left_semi").withColumn(place, F.row_number().over(longest)).filter(F.col(place) == 1).drop(place)
        out = _without(out, again).unionByName(once)
    return out.drop(digest)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by 5-gram similarity of 0.8 or more, one stays: that with
    the smallest doc_id, rows without one coming last.  Rows are told apart by
    numbers written beside them, so rows that share a doc_id, or have none, are
    linked and kept each by its own text."""
    place = _free(docs, "place")
    numbered = util.written(docs.withColumn(place, F.monotonically_increasing_id()))
    found = jaccard.similar_components(numbered.select(F.col(place).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    many = util.written(found.filter("row <> group"))  # all but the first row of every group
    heads = many.select(F.col("group").alias("row"), "group").distinct()
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(place).alias("row"))
    owners = numbered.select(F.col(place).alias("row"), who.alias("who"))
    linked = util.written(many.unionByName(heads).join(owners, "row").select("group", "who"))
    first = linked.groupBy("group").agg(F.min("who").alias("stays"))
    gone = linked.join(first, "group").filter("who <> stays").select(F.col("who.row").alias("_gone" + place))
    return _without(numbered, util.written(gone)).drop(place)


@_stage
def cover_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are covered, and n_chars
    counts a text that has changed anew."""
    covered = _free(docs, "covered")
    out = docs.withColumn(covered, secrets.redacted(docs["text"], secrets.fit(docs)))
    if "n_chars" in docs.columns:
        n = F.char_length(covered).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(covered) != F.col("text"), n).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(covered)).drop(covered)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", cover_secrets),
    ("best-fit packing", pack_sequences),
]

#: Trained models and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.load(spark, sf_dir, "documents")
    for name, work in STAGES:
        path = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        result = work(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
