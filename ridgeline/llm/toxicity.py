"""Operator 8: toxicity by maximum-scoring segments.

Words and word beginnings get log-odds of toxic against clean labelled texts,
smoothed by Dirichlet priors: the prior of a longer feature is the posterior of
its beginning, that of the shortest is the share of toxic texts.  A token
scores the log-odds, positive or negative, of the longest counted feature of
its word, less a constant cost; one that was never counted has the log-odds of
the prior, which is 0.  The k-th time that a token with evidence occurs in a
text it has a k-th of its log-odds, as weights count texts, not occurrences.
Scripts without spaces are read as pairs of letters.

A linear scan (Ruzzo and Tompa) then finds all maximal-scoring passages of a
text.  Their scores become significances by extreme-value (Gumbel) calibration
against the clean texts and the text's length; the sum over significant
passages becomes a probability by a logistic curve.  Both are fitted on
passages that weights from the other half of the labelled texts find.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import util, words

#: Labelled rows a model is fitted on at most: those with the smallest hash of
#: doc_id.  Scores, lengths and passages cover every row.
TRAIN_ROWS = 30_000
#: Features a model holds at most, those of most texts first, and the texts
#: that one must occur in; a word without its own goes by its longest beginning.
MAX_FEATURES, LEAST_DOCS = 100_000, 3
#: Lengths of word beginnings; prior weight in documents; what a token costs a passage.
BEGINNINGS, PRIOR_DOCS, COST = range(3, 9), 20.0, 1.0
#: Hashes of a text's sketch, and the similarity of three-word sets that makes near copies.
SKETCH, SIMILAR = 128, 0.8
#: Intercept of the curve where the labels give none below 0: no evidence means clean.
CLEAN = -3.0
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts without spaces: Thai to Myanmar, Khmer, kana and Han.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_TABLES: dict[str, words.Table] = {}


def pairs(word: str) -> list[str]:
    """A word as it is; one in a script without spaces as its pairs of letters."""
    return [word[i:i + 2] for i in range(max(1, len(word) - 1))] if _DENSE.search(word) else [word]


def tokens_of(text: str) -> list[str]:
    """White-space tokens in lower case; those with letters of a script without spaces by ``pairs``."""
    tokens = text.lower().split()
    if not _DENSE.search(text):
        return tokens
    return [p for t in tokens for p in ((q for w in _WORD.findall(t) for q in pairs(w)) if _DENSE.search(t) else (t,))]


def features(word: str) -> list[str]:
    """Beginnings, shortest first, then the word itself (ended by a space)."""
    return [word[:k] for k in BEGINNINGS if k < len(word)] + [word + " "]


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for p in pairs(w) for f in features(p)}


def sketch(text: str) -> list[int]:
    """Smallest hashes of three neighbouring words, at most SKETCH, ascending."""
    w = [zlib.crc32(x.encode()) for x in _WORD.findall(text.lower())]
    if len(w) < 3:
        return [zlib.crc32(repr(w).encode())]
    a = np.array(w, np.uint64)
    h = (a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:]
    return np.unique(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1))[:SKETCH].astype(np.int64).tolist()


def segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time.

    Candidates hold the sums before and after them, ``left`` and ``right``;
    ``link`` is the nearest earlier candidate with a smaller ``left``.  A
    search follows the links, so it passes a candidate over only once.
    """
    each = np.asarray(scores, np.float64)
    total = np.cumsum(each)
    at = np.flatnonzero(each > 0)
    start, end, left, right, link = [], [], [], [], []
    for i, before, after in zip(at.tolist(), (total[at] - each[at]).tolist(), total[at].tolist(), strict=True):
        own, j = i, len(left) - 1
        while j >= 0 and left[j] >= before:
            j = link[j]
        while j >= 0 and right[j] < after:  # one with a smaller left and right: the two are one
            own, before, next_j = start[j], left[j], link[j]
            del start[j:], end[j:], left[j:], right[j:], link[j:]
            j = next_j
        start.append(own)
        end.append(i + 1)
        left.append(before)
        right.append(after)
        link.append(j)
    return [(s, e, r - b) for s, e, b, r in zip(start, end, left, right, strict=True)]


@dataclass
class Model:
    weights: dict[str, float]
    cost: float = COST
    rate: float = 1.0  # Gumbel decay; log-odds scores make it 1
    k: float = 1e-3
    curve: tuple[float, float] = (CLEAN, 2.0)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def weight(self, token: str) -> float:
        """Largest log-odds among the words of a token (0 where there is none), less its cost."""
        found = [next((self.weights[f] for f in reversed(features(w)) if f in self.weights), 0.0) for w in _WORD.findall(token)]
        return max(found, default=0.0) - self.cost

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of tokens, segments by token)."""
        table = _TABLES.get(self.name)
        if table is None:
            if len(_TABLES) > 1:  # the two halves of a fit
                _TABLES.clear()
            table = _TABLES[self.name] = words.Table(self.weight)
        tokens = tokens_of(text)
        scores = list(map(table.__getitem__, tokens))
        if not scores or max(scores) <= 0:
            return len(scores), []
        seen: dict[str, int] = {}
        for i, x in enumerate(scores):
            if x > 0:
                k = seen[tokens[i]] = seen.get(tokens[i], 0) + 1
                scores[i] = (x + self.cost) / k - self.cost
        return len(scores), segments(scores)

    def significance(self, n: int, scores) -> float:
        """Sum over the passages of how far each lies above the Gumbel location of n clean tokens."""
        base = math.log(self.k * max(n, 1))
        return sum(x for x in (self.rate * s - base for s in scores) if x > 0)

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(self.significance(n, [s for _, _, s in found]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out() -> Column:
    """Rows that a model never sees."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def _weights(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """feature -> log-odds against the share of toxic texts; beginnings come
    before what extends them."""
    p0 = toxic / (toxic + clean)
    base = math.log(p0 / (1 - p0))
    share: dict[str, float] = {}
    out = {}
    for f, t, c in sorted(counts, key=lambda x: (len(x[0].rstrip(" ")), x[0][-1] == " ", x[0])):
        own = f.rstrip(" ")
        prior = next((share[own[:k]] for k in reversed(BEGINNINGS) if own[:k] != f and own[:k] in share), p0)
        p = share[f] = (t + PRIOR_DOCS * prior) / (t + c + PRIOR_DOCS)
        out[f] = math.log(p / (1 - p)) - base
    return out


def _newton(a: np.ndarray, y: np.ndarray, offset: float = 0.0) -> np.ndarray:
    """Ridge logistic regression of y on the columns of ``a`` by Newton's method."""
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(offset + a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(len(w)), a.T @ (y - p) - 0.01 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of y on x.  Where mostly toxic labels would call a text
    without evidence toxic, the intercept is CLEAN and only the slope is fitted."""
    w = _newton(np.stack([np.ones_like(x), x], 1), y)
    if w[0] < 0:
        return float(w[0]), float(w[1])
    return CLEAN, float(_newton(x[:, None], y, CLEAN)[0])


def _labelled(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """row, doc_id, toxic, text, fold, sketch of at most ``train_rows`` labelled
    rows that are not held out, without near copies of one label: the rows with
    the smallest hashes of doc_id, then of the text."""
    sample = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
              .groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows))

    def draw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sketch(x) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))],
                                             ["doc_id", "toxic", "text", "sketch"])

    t = util.texts(docs)
    rows = util.written(t.join(F.broadcast(sample), t.doc_id == sample.label_id).select("doc_id", "toxic", "text")
                        .mapInArrow(draw, "doc_id bigint, toxic int, text string, sketch array<bigint>")
                        .withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("text")}))
    some = rows.select("row", "toxic", "sketch", F.struct(F.xxhash64("doc_id").alias("a"), "doc_id", "h", "row").alias("place"))
    some = util.written(some.orderBy("place").limit(train_rows))
    alike = some.withColumn("least", F.col("sketch")[0])
    first = alike.groupBy("toxic", "least").agg(F.min_by(F.struct("row", "sketch"), "place").alias("first"))
    both = F.slice(F.array_sort(F.array_union("sketch", "first.sketch")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(both, F.col("sketch")), F.col("first.sketch"))) / F.size(both)
    stay = alike.join(first, ["toxic", "least"]).filter((F.col("row") == F.col("first.row")) | (shared < SIMILAR)).select("row")
    return util.written(rows.join(F.broadcast(stay), "row").withColumn("fold", F.pmod(F.xxhash64("doc_id", "h"), F.lit(2)).cast("int")))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model from the labelled rows that are not held out: at most
    ``train_rows`` rows, however many share a doc_id.  Copies and near copies
    of one label count once.  No evidence means clean: without usable rows of
    both classes the model finds nothing and every text gets the same score,
    well below 0.5; with them, a text without evidence (a null or empty one,
    too) scores below 0.5 however many labels are toxic."""
    train = _labelled(docs, labels, train_rows)
    schema = ["f", *(f"n{fold}{y}" for fold in (0, 1) for y in (0, 1))]

    def count(batches):
        seen: dict[str, list[int]] = {"": [0] * 4}
        for b in batches:
            for fold, y, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for f in ("", *text_features(text)):
                    seen.setdefault(f, [0] * 4)[2 * fold + y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([n[i] for n in seen.values()], pa.int64()) for i in range(4))], schema)

    counted = (train.select("fold", "toxic", "text").mapInArrow(count, ", ".join(["f string", *(f"{c} bigint" for c in schema[1:])]))
               .groupBy("f").agg(*[F.sum(c).alias(c) for c in schema[1:]]).withColumn("n", sum((F.col(c) for c in schema[1:]), F.lit(0))))
    kept = counted.filter((F.col("n") >= LEAST_DOCS) | (F.col("f") == "")).orderBy(F.col("f") != "", F.desc("n"), "f").limit(MAX_FEATURES + 1)
    table = kept.select(schema).toPandas()
    clean, toxic = {}, {}  # by the fold left out; None: no fold
    for out, use in ((None, (0, 1)), (0, (1,)), (1, (0,))):
        clean[out], toxic[out] = (sum(table[f"n{k}{y}"] for k in use).to_numpy() for y in (0, 1)) if len(table) else (np.zeros(1), np.zeros(1))
    if not clean[None][0] or not toxic[None][0]:
        return Model({}, curve=(CLEAN, 0.0))

    def weights(out):
        there = np.flatnonzero(clean[out] + toxic[out])[1:]
        return _weights([(table["f"][i], int(toxic[out][i]), int(clean[out][i])) for i in there.tolist()], int(toxic[out][0]), int(clean[out][0]))

    model = Model(weights(None))
    halves = all(clean[k][0] and toxic[k][0] for k in (0, 1))  # else too few rows to set any apart
    other = [Model(weights(k)) if halves else model for k in (0, 1)]

    def measure(batches):  # tokens and passage scores of each training text
        for b in batches:
            got = [other[k].passages(x) for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([max(g[0], 1) for g in got], pa.int64()), pa.array([[s for _, _, s in g[1]] for g in got], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    seen = util.written(train.select("fold", "toxic", "text").mapInArrow(measure, "toxic int, n bigint, scores array<double>"))
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    model.k = seen.filter("toxic = 0").agg(F.count("*") / F.sum(F.col("n") * F.exp(-model.rate * best))).first()[0]
    above = F.transform("scores", lambda x: F.greatest(model.rate * x - F.log(model.k * F.col("n")), F.lit(0.0)))
    e = seen.select("toxic", F.aggregate(above, F.lit(0.0), lambda total, x: total + x).alias("e")).toPandas()  # two numbers a row
    model.curve = _logistic(np.log1p(e["e"].to_numpy()), e["toxic"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted,
    n_passages.  Null texts count as empty and get the score of a text without
    evidence; other columns are ignored; repeated rows score alike; an empty
    table gives no rows."""
    def run(batches):
        for b in batches:
            found = [model.passages(x) for x in b.column(1).to_pylist()]
            s = [model.score(*x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()),
                                              pa.array([len(x[1]) for x in found], pa.int64())], ["doc_id", "score", "predicted", "n_passages"])
    scored = util.texts(docs).mapInArrow(run, "doc_id bigint, score double, predicted int, n_passages bigint")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_passages")


def is_toxic(text: Column, model: Model, threshold: float = 0.5) -> Column:
    """Whether a text scores ``threshold`` or more (null counts as empty)."""
    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: model.score(*model.passages(x)) >= threshold).astype(bool)
    return judge(F.coalesce(text, F.lit("")))
