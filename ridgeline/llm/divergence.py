"""Operator 11: audit of how far the sources of a language diverge.

Each source's distribution over the terms of its language is held against
every other source's, in fixed point.  The work is a cube of (group block,
group block, term block) cells: a slice (one block of groups, one block of
terms) is sent to every cell that needs it, a task holds the two slices of its
cell and sums the partial divergences of their pairs, and the sums are added
along the term axis.  Blocks are hashes, and their number follows from counts,
so that a cell stays within the stated size however many sources and terms
there are.

Terms are counted inside Arrow batches, so only sums of a task are shuffled.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm import util

#: Parts of a whole; least documents of a kept term; terms reported by group.
SCALE, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 3, 200
#: Groups and terms that a block holds on average.
BLOCK_GROUPS, BLOCK_TERMS = 16, 16_384
#: Distinct terms that a counting task holds before it hands on its sums.
HELD_TERMS = 400_000
#: Bytes that belong to a term map to themselves (A-Z to a-z), others to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A share is worked out in three steps of a thousand each, in 64 bits.
_STEPS, _STEP = 3, 1000

COUNTS = "lang string, source string, term string, times bigint, docs bigint"


def terms(raw: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of letters A-Z, lower-cased, and characters beyond ASCII."""
    return raw.translate(_FOLD).split()


def _count(docs: DataFrame) -> DataFrame:
    """Sums by task of (lang, source, term); a row with an empty term for every group."""
    text = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], util.body(docs).cast("binary").alias("raw"))

    def rows(times: dict, within: dict):
        for (lang, source), c in times.items():
            d = within[lang, source]
            names = [b"", *c]
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            cols = [[lang] * len(names), [source] * len(names), [x.decode() for x in names], [0, *c.values()], [0, *map(d.__getitem__, c)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["lang", "source", "term", "times", "docs"])

    def run(batches):
        times: dict[tuple, Counter] = {}
        within: dict[tuple, Counter] = {}
        for b in batches:
            found: dict[tuple, list] = {}
            for lang, source, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.setdefault((lang, source), []).append(terms(raw))
            for group, lists in found.items():
                times.setdefault(group, Counter()).update(chain.from_iterable(lists))
                within.setdefault(group, Counter()).update(chain.from_iterable(map(set, lists)))
            if sum(map(len, times.values())) > HELD_TERMS:
                yield from rows(times, within)
                times, within = {}, {}
        yield from rows(times, within)

    return text.mapInArrow(run, COUNTS)


def share(count: Column, of: Column) -> Column:
    """1 + floor(SCALE * count / of), exact in 64 bits while ``of`` < 9e15."""
    out, rest = F.lit(0).cast("bigint"), count
    for _ in range(_STEPS):
        out = out * _STEP + F.call_function("div", rest * _STEP, of)
        rest = rest * _STEP % of
    return out + 1


def shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``share`` of whole arrays."""
    out, rest = np.zeros_like(count), count
    for _ in range(_STEPS):
        rest = rest * _STEP
        out = out * _STEP + rest // of
        rest = rest % of
    return out + 1


def cell(frame: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of the pairs of one cell: of every ordered pair of
    groups from blocks a and b, over the kept terms of one term block.
    ``frame`` has a row without a term for every group, and the counts."""
    heads = frame[frame["term"].isna()].drop_duplicates("source")
    counts = frame[frame["term"].notna()]
    place = {x: i for i, x in enumerate(heads["source"])}
    codes, found = pd.factorize(counts["term"])
    times = np.ones((len(place), len(found) + 1), np.int64)  # the last: a term that no group here has
    times[counts["source"].map(place).to_numpy(np.int64), codes] += counts["times"].to_numpy(np.int64)
    first = heads.iloc[0]
    weight = np.ones(len(found) + 1, np.int64)
    weight[-1] = first["block_terms"] - len(found)
    p = shares(times, (heads["n"] + heads["v"]).to_numpy(np.int64)[:, None]) if first["v"] else times
    block, names = heads["block"].to_numpy(), heads["source"].to_numpy(object)
    out = []
    for i in range(len(names)):
        other = block == (first["b"] if block[i] == first["a"] else first["a"])
        other[i] = False
        q = p[other]
        out.append(pd.DataFrame({"source": names[i], "item": names[other], "value": ((p[i] - q) ** 2 // q * weight).sum(1)}))
    return pd.concat(out).assign(lang=first["lang"])[["lang", "source", "item", "value"]]


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_groups: int = BLOCK_GROUPS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Divergence of every (lang, source) group of ``docs`` from the other
    sources of its language (part 'pair'), and the terms that it uses more than
    its language does (part 'term', the first ``top_terms``): lang, source,
    part, item, value, rank.

    Null text, lang and source are read as ''; groups without terms take part
    (with even shares); a language without kept terms gives pairs of value 0; a
    group alone in its language gives no pair.  Repeated rows count each as a
    document; ties rank by item; an empty table gives no rows; other columns
    are ignored.
    """
    util.ship(docs.sparkSession)
    by_term = Window.partitionBy("lang", "term")
    summed = (_count(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))
              .withColumn("all_docs", F.sum("docs").over(by_term)).withColumn("all_times", F.sum("times").over(by_term)))
    kept = util.written(summed.filter((F.col("term") == "") | (F.col("all_docs") >= least_docs)).select("lang", "source", "term", "times", "all_times"))
    counts = kept.filter("term <> ''")

    vocabulary = util.written(counts.select("lang", "term", "all_times").distinct())
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_times").alias("n_lang"))
    groups = kept.groupBy("lang", "source").agg(F.sum("times").alias("n"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(sizes, "lang", "left").na.fill(0)
    blocks = lambda x, size: F.greatest(F.lit(1), F.ceil(F.col(x) / size)).cast("int")
    langs = util.bounded(util.written(langs.withColumn("blocks", blocks("g", block_groups)).withColumn("term_blocks", blocks("v", block_terms))))
    groups = util.written(groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))

    term_block = F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("t")
    in_block = util.bounded(util.written(vocabulary.join(langs, "lang").select("lang", term_block).groupBy("lang", "t").agg(F.count("*").alias("block_terms"))))
    heads = (groups.select("lang", "source", "block", "blocks", "n", "v", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("t"))
             .join(in_block, ["lang", "t"], "left").select("lang", "t", "source", "block", "blocks", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("times"), "n", "v", F.coalesce("block_terms", F.lit(0)).alias("block_terms")))
    own = counts.join(util.bounded(groups), ["lang", "source"])
    zero = F.lit(0).cast("bigint")
    slices = heads.unionByName(own.select("lang", term_block, "source", "block", "blocks", "term", "times", zero.alias("n"), zero.alias("v"), zero.alias("block_terms")))
    cells = (slices.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("a", F.least("block", "with")).withColumn("b", F.greatest("block", "with")).drop("with", "blocks"))
    partial = cells.groupBy("lang", "a", "b", "t").applyInPandas(cell, "lang string, source string, item string, value bigint")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    p, q = share(F.col("times") + 1, F.col("n") + F.col("v")), share(F.col("all_times") + 1, F.col("n_lang") + F.col("v"))
    more = own.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    listed = (more.select("lang", "source", "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
              .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(listed.withColumn("part", F.lit("term")).select(columns))
