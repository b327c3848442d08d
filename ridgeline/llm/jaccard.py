"""Operator 6: n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is its distinct word 5-grams, as 64-bit hashes.  Documents
with equal sets are one class.  All hashes have one global order, rare ones
first; the order comes from bucketed counts over the whole corpus.  Two sets of
Jaccard similarity t or more share at least l hashes among the first
|x| - ceil(t |x|) + l of each (and that for every l up to their least overlap).
Each class chooses the l of least estimated cost: a longer prefix is more to
look through, but asks for more shared hashes before a pair is verified.  A
pair needs as many as the smaller l of the two, so no link is lost.

Near copies come in large groups, whose pairs must not be listed.  First, each
class is verified against one representative (its home) among those that share
its minimum hashes, the one whose hashes are most common, as an original is;
what is linked becomes one component.  Classes that aren't linked with their
home, such as copies of another text that quotes it, get a second
representative by the hashes that the home hasn't.  Two classes of one home can
then only be similar if they share hashes beside it; they are compared by the
rarest of those, as many as one of which they must share.  All others are
counted by shared prefix hashes.  Only pairs of different components are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm import graph, util

WORDS, PERCENT = 5, 80
#: Buckets of the counts that order the hashes (a fixed 2 MB on every task).
ORDER_BUCKETS = 1 << 18
#: Largest number of required matches; cost of verifying a pair against looking at a posting.
MOST_MATCHES, VERIFY_COST = 8, 10.0
#: Minimum hashes for the first round, and how many two classes must share there.
SKETCH, SKETCH_SHARED = 12, 5
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: bytes, width: int = WORDS, seed: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of UTF-8 ``text``; bytes.lower
    and bytes.split know A-Z and the six ASCII spaces only, as asked for."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    w = np.array([h(x, seed) for x in words], np.uint64)
    k = min(n, width)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s += (w[i:n - k + 1 + i] ^ (w[i:n - k + 1 + i] >> np.uint64(31))) * _PLACE[i % 5] * np.uint64(2 * i + 1)
    s ^= s >> np.uint64(30)
    s *= _MIX1
    s ^= s >> np.uint64(27)
    s *= _MIX2
    return np.unique(s ^ (s >> np.uint64(31)))


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    import xxhash

    raw = s.tobytes()
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh64_intdigest(raw, 7) - (1 << 63)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def choose(weights: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost.  ``weights``: estimated
    documents per hash, in global order."""
    overlap = least_overlap(n, percent)
    first = n - overlap + 1
    most = min(MOST_MATCHES, overlap)
    seen = np.cumsum(weights[: first + most - 1])[first - 1:]
    matches = np.arange(1, most + 1)
    best = int(np.argmin(seen * (1 + VERIFY_COST / matches)))
    return best + 1, first + best


def _bytes(docs: DataFrame, seed: int = 0) -> DataFrame:
    return util.texts(docs).select("doc_id", F.col("text").cast("binary").alias("raw"))


def _measure(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Per row: doc_id, n, set_id, check; and per task: bucket counts."""
    schema = "doc_id bigint, n bigint, set_id bigint, check bigint, bucket array<int>, times array<bigint>"

    def run(batches):
        total = np.zeros(ORDER_BUCKETS, np.int64)
        names = ["doc_id", "n", "set_id", "check", "bucket", "times"]
        longs = pa.list_(pa.int64())
        for b in batches:
            n, ids, check = [], [], []
            seen = []
            for raw in b.column(1).to_pylist():
                s = shingles(raw, width, seed)
                a, c = set_id(s)
                n.append(len(s))
                ids.append(a)
                check.append(c)
                seen.append(s)
            if seen:
                flat = np.concatenate(seen)
                total += np.bincount((flat & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64), minlength=ORDER_BUCKETS)
            nothing = pa.nulls(len(n), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(check, pa.int64()), nothing, pa.nulls(len(n), longs)], names)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64())] * 4 + [pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[used]], longs)], names)

    return _bytes(docs).mapInArrow(run, schema)


def _prefixes(docs: DataFrame, counts: np.ndarray, width: int, percent: int, seed: int) -> DataFrame:
    """set_id, n, l, tokens, minimum hashes and commonness (mean log
    count of its hashes) of every row that has words."""
    usual = np.median(counts[counts > 0]) if counts.any() else 0
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        counts = shared.value
        for b in batches:
            ids, n, matches, tokens, low, common = [], [], [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingles(raw, width, seed)
                if not len(s):
                    continue
                f = counts[(s & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)]
                order = np.argsort(f, kind="stable")
                weights = np.maximum(f[order] - usual, 1)
                m, length = choose(weights, len(s), percent)
                low.append(s[:SKETCH].view(np.int64))
                common.append(float(np.log(weights).mean()))
                ids.append(set_id(s)[0])
                n.append(len(s))
                matches.append(m)
                tokens.append(s[order[:length]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(matches, pa.int32()), pa.array(tokens, pa.list_(pa.int64())),
                                              pa.array(low, pa.list_(pa.int64())), pa.array(common, pa.float64())], ["set_id", "n", "l", "tokens", "sketch", "common"])

    return _bytes(docs).mapInArrow(run, "set_id bigint, n bigint, l int, tokens array<bigint>, sketch array<bigint>, common double")


def _verified(docs: DataFrame, pairs: DataFrame, members: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """Per pair (a, b) of set_ids: whether their sets are similar enough, the
    size of the intersection, and the hashes that only a has.  ``members``: doc
    rows (doc_id, set_id); texts are read again for the classes in pairs."""
    ids = util.written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    some = util.written(members.join(util.bounded(ids), F.col("set_id") == F.col("id"), "left_semi").groupBy("set_id").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("one")))

    def run(batches):
        for b in batches:
            sets = [shingles(x, width, seed) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s)[0] for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "hashes"])

    wanted = util.bounded(some.select("one").distinct())
    texts = _bytes(docs)
    sets = (texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["one"]), "left_semi").select("raw")
            .mapInArrow(run, "id bigint, hashes array<bigint>").join(util.bounded(ids), "id", "left_semi"))
    sets = util.written(sets.dropDuplicates(["id"]))

    def similar(batches):
        for b in batches:
            x, y = b.column(2), b.column(3)
            alike, both, rest = [], [], []
            for i in range(b.num_rows):
                p, q = x[i].values.to_numpy(zero_copy_only=False), y[i].values.to_numpy(zero_copy_only=False)
                shared = np.intersect1d(p, q, assume_unique=True)
                alike.append(100 * len(shared) >= percent * (len(p) + len(q) - len(shared)))
                both.append(len(shared))
                rest.append(np.setdiff1d(p, shared, assume_unique=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike, pa.bool_()), pa.array(both, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "alike", "both", "rest"])

    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint, alike boolean, both bigint, rest array<bigint>")


def _represented(low: DataFrame, within: list[str]) -> DataFrame:
    """Candidates (a, b) from rows (set_id, size, common, low, *within): each
    class with the most common one (that whose hashes are most frequent, as the
    original of many copies is) of those that share a minimum hash, where the
    two share enough of them."""
    key = [*within, "low"]
    most = F.max_by("set_id", F.struct("common", "set_id")).alias("b")
    least = util.written(low.groupBy(*key).agg(most, F.count("*").alias("c")).filter("c > 1").select(*key, "b"))
    met = low.join(least, key).filter("set_id <> b").groupBy("set_id", "b").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    enough = F.col("shared") >= F.least(F.lit(SKETCH_SHARED), F.col("size"))
    best = met.filter(enough).groupBy("set_id").agg(F.max(F.struct("shared", "b")).alias("best"))
    return best.select(F.col("set_id").alias("a"), F.col("best.b").alias("b"))


def _first_round(prefixes: DataFrame) -> DataFrame:
    return _represented(prefixes.select("set_id", F.col("n").alias("size"), "common", F.explode("sketch").alias("low")), [])


def _again(tried: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Second representatives, by the minimum hashes beside the home."""
    least = F.slice(F.sort_array("rest"), 1, SKETCH)
    apart = tried.filter("not alike").select(F.col("a").alias("set_id"), F.col("b").alias("home"), F.size("rest").alias("size"), F.explode(least).alias("low"))
    return _represented(apart.join(prefixes.select("set_id", "common"), "set_id"), ["home"])


def _overlap(percent: int) -> Column:
    """Least intersection of two similar sets of n1 and n2 hashes."""
    return F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent))


def _across(told: DataFrame, key: list[str], columns: list[str], alike: Column) -> DataFrame:
    """Pairs of rows of ``told`` that share ``key`` and are of different
    components, columns numbered 1 and 2.  A key's largest component meets the
    others; it isn't paired with itself, however large."""
    main = util.written(told.groupBy(*key, "comp").agg(F.count("*").alias("c")).groupBy(*key).agg(F.max_by("comp", F.struct("c", "comp")).alias("main")))
    told = util.written(told.join(main, key))
    x = told.filter("comp <> main").select(*key, *[F.col(c).alias(c + "1") for c in columns])
    y = told.select(*key, F.col("main").alias("main2"), *[F.col(c).alias(c + "2") for c in columns])
    alike &= F.col("comp1") != F.col("comp2")
    with_main = x.join(y.filter("comp2 = main2"), key).filter(alike)
    return with_main.unionByName(x.join(y.filter("comp2 <> main2"), key).filter(alike & (F.col("set_id1") < F.col("set_id2"))))


def _beside_home(tried: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of one home but different components.  Their
    intersection is at most the smaller one with the home, plus the hashes that
    both have beside it.  A set that is similar to x lacks at most n - ceil(t n)
    of x's hashes, so of any one more it has some: two such classes share one
    of their rarest hashes beside the home (rare among its classes)."""
    own = tried.select(F.col("a").alias("set_id"), F.explode("rest").alias("token")).join(prefixes.select("set_id", "comp", "n", "home", "o"), "set_id")
    own = util.written(own)
    spread = util.written(own.groupBy("home", "token").agg(F.count("*").alias("c"), (F.min("comp") < F.max("comp")).alias("mixed")).filter("c > 1"))
    rarest = Window.partitionBy("set_id").orderBy(F.coalesce("c", F.lit(1)), "token")
    told = (own.join(spread, ["home", "token"], "left").withColumn("place", F.row_number().over(rarest))
            .filter(F.col("mixed") & (F.col("place") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).drop("c", "mixed", "place"))
    met = _across(util.written(told), ["home", "token"], ["set_id", "comp", "n", "o"], 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    return met.select(F.least("set_id1", "set_id2").alias("a"), F.greatest("set_id1", "set_id2").alias("b")).distinct()


def _second_round(prefixes: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different components with enough shared prefix
    tokens.  Two classes of one home (representative) are left to
    ``_beside_home`` unless what each shares with the home would be enough."""
    posted = prefixes.select("set_id", "comp", "n", "l", "home", "o", F.size("tokens").alias("p"), F.explode("tokens").alias("token"))
    shared = util.written(posted.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token"))
    overlap = _overlap(percent)
    apart = ~F.coalesce(F.col("home1") == F.col("home2"), F.lit(False)) | (F.least("o1", "o2") >= overlap)
    met = _across(util.written(posted.join(shared, "token")), ["token"], ["set_id", "comp", "n", "l", "p", "home", "o"], apart & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")))
    # Of the two prefixes, the common hashes up to the end of the one that ends
    # first are in both; beyond it that set has only its n - p last hashes.
    need = F.greatest(F.least("l1", "l2"), overlap - F.greatest(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")))
    met = met.select(F.least("set_id1", "set_id2").alias("a"), F.greatest("set_id1", "set_id2").alias("b"), need.alias("need"))
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")


def similar_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links of Jaccard similarity ``percent`` / 100 or more).

    Null and empty texts, and texts without words, have 0 shingles and link
    with nothing: component_id is their own doc_id.  Texts of fewer than
    ``width`` words are one shingle.  Null doc_ids stay null and are never a
    component_id if there is another; repeated rows and equal sets are one
    class; other columns are ignored; an empty table gives no rows.
    """
    seed = 0
    while True:
        measured = util.written(_measure(docs, width, seed))
        members = measured.filter("set_id is not null").select("doc_id", "n", "set_id", "check")
        if members.groupBy("set_id").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b").isEmpty():
            break
        seed += 1  # two sets of one set_id: hash anew
    members = members.drop("check")
    some = members.filter("n > 0")
    buckets = (measured.filter("bucket is not null").select(F.explode(F.arrays_zip("bucket", "times")).alias("z"))
               .groupBy("z.bucket").agg(F.sum("z.times").alias("times")).toPandas())  # ORDER_BUCKETS rows at most
    counts = np.zeros(ORDER_BUCKETS, np.int64)
    counts[buckets["bucket"].to_numpy(np.int64)] = buckets["times"].to_numpy(np.int64)

    prefixes = util.written(_prefixes(docs, counts, width, percent, seed).dropDuplicates(["set_id"]))
    tried = util.written(_verified(docs, util.written(_first_round(prefixes)), some, width, percent, seed))
    second = _verified(docs, util.written(_again(tried, prefixes)), some, width, percent, seed)
    first = util.written(tried.unionByName(second).filter("alike").select("a", "b"))
    known = util.bounded(util.written(graph.components(first)))
    homes = util.bounded(util.written(tried.select(F.col("a").alias("x"), F.col("b").alias("home"), F.col("both").alias("o"))))
    prefixes = (prefixes.join(known, F.col("set_id") == F.col("node"), "left").join(homes, F.col("set_id") == F.col("x"), "left")
                .select("set_id", F.coalesce("root", "set_id").alias("comp"), "n", "l", "home", "o", "tokens"))
    pairs = util.written(_second_round(prefixes, percent).unionByName(_beside_home(tried, prefixes, percent)).distinct())
    links = first.unionByName(_verified(docs, pairs, some, width, percent, seed).filter("alike").select("a", "b"))
    roots = util.written(graph.components(links))
    placed = util.written(members.join(roots, F.col("set_id") == F.col("node"), "left")
                          .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "set_id").alias("root")))
    least = util.written(placed.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return (placed.join(least, "root", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
