"""Operator 4: nearest neighbours by an inverted multi-index.

Each half of a vector is quantised to one of k centroids, so k * k cells hold
the vectors.  A query looks at cells in the order of the summed distances of
its halves to the cell's two centroids; a heap gives the next cell without
listing all of them.  It stops once the cells hold enough vectors; the summed
distance reached there tells which cells those are.  Their members are ranked
by exact inner products in double precision.

Equal vectors are one entry with their smallest ids, which is all that a list
of ``top`` neighbours can show of them.  Cells are dealt in blocks of bounded
size, large ones over several; a query goes to the blocks that it visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm import util

TOP = 20
#: Entries that the centroids are fitted on at most (smallest hashes of vec_id), and passes.
SAMPLE_ROWS, PASSES = 20_000, 12
#: Centroids per half at most; entries a cell should hold on average below that.
MOST_CENTROIDS, CELL_ENTRIES = 1024, 4
#: Entries that a query's cells hold at least: a number, and a share of all.
#: Vectors without any structure need this share for a recall of 0.9.
CANDIDATES, SHARE = 2000, 0.5
#: Entries and queries that a block takes.
BLOCK_ENTRIES, BLOCK_QUERIES = 8192, 2048


def usable(v: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def centroids(x: np.ndarray, k: int, passes: int = PASSES) -> np.ndarray:
    """k-means from a seeded start."""
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(passes):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c ** 2).sum(1) - 2 * x @ c.T, axis=1)


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T summed in the order of the components, so that a row's values
    don't depend on the rows beside it (BLAS rounds by the batch's shape)."""
    out = np.zeros((len(x), len(c)))
    for a, b in zip(x.T, c.T, strict=True):
        out += a[:, None] * b
    return out


def traverse(d1: np.ndarray, d2: np.ndarray, held: list[int], wanted: int) -> float:
    """The summed distance d1[i] + d2[j] at which the nearest cells i * k + j
    hold ``wanted`` entries (infinite if all cells hold fewer)."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, k = d1[o1].tolist(), d2[o2].tolist(), len(d2)
    o1, o2 = o1.tolist(), o2.tolist()
    heap, got = [(s1[0] + s2[0], 0, 0)], 0
    far = 0.0
    while heap and got < wanted:
        far, i, j = heappop(heap)
        got += held[o1[i] * k + o2[j]]
        if j + 1 < len(s2):
            heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return far if got >= wanted else float("inf")


def entries(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """(embedding, ids): distinct usable vectors with their top + 1 smallest ids."""
    t = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    t = t.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("r") <= top + 1)
    return first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, every: int = 20, top: int = TOP, candidates: int = CANDIDATES, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each query.

    Queries are the usable vectors whose vec_id is divisible by ``every``;
    ties go to the smaller vec_id.  Vectors that are null, zero, hold null or
    non-finite components, have no vec_id or another length than most take no
    part; repeated rows count once; other columns are ignored; an empty table
    gives no rows.  With at most ``candidates`` entries the search is exact.
    """
    spark = vectors.sparkSession
    util.ship(spark)
    every_length = util.written(entries(vectors, top))
    sizes = every_length.groupBy(F.size("embedding").alias("d")).agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("c")).orderBy(F.desc("n"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    held_by_all = every_length.filter(F.size("embedding") == sizes.d)
    sample = held_by_all.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(SAMPLE_ROWS).select("embedding").toPandas()
    x = np.stack(sample["embedding"].to_numpy()).astype(np.float64)
    half = max(1, sizes.d // 2)
    k = int(min(MOST_CENTROIDS, max(2, round((sizes.c / CELL_ENTRIES) ** 0.5)), len(x)))
    c1 = centroids(x[:, :half], k)
    c2 = centroids(x[:, half:], k) if sizes.d > 1 else np.zeros((1, 0))
    k2 = len(c2)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = np.stack(f["embedding"].to_numpy()).astype(np.float64)
                yield f.assign(i=nearest(v[:, :half], c1), j=nearest(v[:, half:], c2) if k2 > 1 else 0)

    index = util.written(held_by_all.mapInPandas(place, "embedding array<double>, ids array<bigint>, i int, j int"))
    counts = index.groupBy("i", "j").agg(F.count("*").alias("n")).toPandas()  # k * k rows at most
    held = np.zeros((len(c1), k2), np.int64)
    held[counts["i"], counts["j"]] = counts["n"]
    wanted = max(candidates, int(np.ceil(share * sizes.c)))
    # blocks: runs of first centroids, and parts of those that are too large
    block = np.concatenate([[0], np.cumsum(held.sum(1))[:-1] // BLOCK_ENTRIES])
    block_parts = [max(1, -(-int(n) // (2 * BLOCK_ENTRIES))) for n in np.bincount(block, held.sum(1))]
    shared = spark.sparkContext.broadcast(held.ravel().tolist())

    def distances(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -products(v[:, :half], c1), -products(v[:, half:], c2) if k2 > 1 else np.zeros((len(v), 1))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d1, d2 = distances(np.stack(f["embedding"].to_numpy()).astype(np.float64))
                far = [traverse(a, b, shared.value, wanted) for a, b in zip(d1, d2, strict=True)]
                go = [sorted({int(x) for x in block[a + b.min() <= t]}) for a, b, t in zip(d1, d2, far, strict=True)]
                yield f.assign(far=far, block=go)

    queries = every_queries(vectors, every).filter(F.size("embedding") == sizes.d)
    visits = util.written(queries.mapInPandas(visit, "query_id bigint, embedding array<double>, far double, block array<int>"))
    dealt = -(-visits.count() // BLOCK_QUERIES)
    parts = spark.createDataFrame([(b, n) for b, n in enumerate(block_parts)], "block int, parts int")
    of = spark.createDataFrame([(i, int(b)) for i, b in enumerate(block)], "i int, block int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (visits.withColumn("block", F.explode("block")).join(F.broadcast(parts), "block").withColumn("part", each(F.col("parts")))
            .withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(max(1, dealt))).cast("int")).select("block", "part", "q", "query_id", "embedding", "far"))
    right = (index.join(F.broadcast(of), "i").join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts")).cast("int"))
             .withColumn("q", each(F.lit(max(1, dealt)))).select("block", "part", "q", "ids", "embedding", "i", "j"))

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            q, v = np.stack(a["embedding"].to_numpy()).astype(np.float64), np.stack(b["embedding"].to_numpy()).astype(np.float64)
            i, j, ids, query, far = b["i"].to_numpy(), b["j"].to_numpy(), b["ids"].to_numpy(), a["query_id"].tolist(), a["far"].to_numpy()
            for start in range(0, len(q), 64):
                some = slice(start, start + 64)
                d1, d2 = distances(q[some])
                scores = np.where(d1[:, i] + d2[:, j] <= far[some, None], q[some] @ v.T, -np.inf)
                for own, s in zip(query[some], scores, strict=True):
                    least = np.partition(s, max(0, len(s) - top - 1))[max(0, len(s) - top - 1)]  # own entry may be among them
                    best = np.flatnonzero((s >= least) & (s > -np.inf))
                    found = sorted((-s[e], m) for e in best for m in ids[e].tolist() if m != own)[:top]
                    out["query_id"] += [own] * len(found)
                    out["vec_id"] += [m for _, m in found]
                    out["score"] += [-x for x, _ in found]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("block", "part", "q").cogroup(right.groupBy("block", "part", "q")).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def every_queries(vectors: DataFrame, every: int) -> DataFrame:
    t = vectors.select(vectors["vec_id"].cast("bigint").alias("query_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    return t.filter((F.col("query_id") % every == 0) & usable(F.col("embedding"))).distinct()
