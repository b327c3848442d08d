"""Exact quantiles by histogram refinement (used by A1 medians, A18 deciles).

``percentile`` keeps a value->count map per group and merges it in one task,
which is unbounded for continuous data.  Here each round is one scan with
partial aggregation: ``groupBy(search, bin).count()`` over ``BINS`` bins of the
current candidate range; the bin holding the wanted rank becomes the next
range, from its least to its greatest value, until those are equal.  Tables of
every size take this one path; no values are fetched, only counts of bins.
Rounds alternate between equal widths and equal ratios, so a few are enough for
any spread of values.  Searches that share a column and candidate range share
one histogram.  Results use linear interpolation between order statistics
(pandas ``quantile`` / DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: Over the logarithm of the smallest double, so that signed logarithms keep order.
LOG_SHIFT = 746.0


def column_profile(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """count / min / max of non-null values per column, one aggregation."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def exact_order_stats(df: DataFrame, ranks: dict[str, Sequence[int]],
                      profile: dict | None = None) -> dict[str, dict[int, float]]:
    """{column: {rank: value}}: the value at each 0-based rank among the
    column's non-null values, found by histogram refinement (exact)."""
    cols = list(ranks)
    prof = profile or column_profile(df, cols)
    searches: dict[tuple[str, int], dict] = {}
    for c in cols:
        n, lo, hi = prof[c]
        for r in ranks[c]:
            if not n or r < 0 or r >= n:
                raise ValueError(f"rank {r} outside 0..{n - 1} for {c}")
            searches.setdefault((c, r), {"lo": lo, "hi": hi, "below": 0, "value": lo if _same(lo, hi) else None})
    for turn in count():
        active = [(k, s) for k, s in searches.items() if s["value"] is None]
        if not active:
            break
        # searches of one column over the same candidate range share one
        # histogram: a row emits at most one entry per column and range
        hists: dict[tuple, int] = {}
        for key, s in active:
            hists.setdefault((key[0], s["lo"], s["hi"]), len(hists))
        items = []
        for (c, lo, hi), hid in hists.items():
            v = F.col(c).cast("double")
            items.append(F.when(v.between(F.lit(float(lo)), F.lit(float(hi))),
                                F.struct(F.lit(hid).alias("sid"), _bin(v, float(lo), float(hi), turn % 2 == 1).alias("b"), v.alias("v"))))
        hist = (df.select(F.explode(F.array(*items)).alias("x")).filter(F.col("x").isNotNull())
                  .groupBy("x.sid", "x.b")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("mn"), F.max("x.v").alias("mx"))
                  .collect())        # at most BINS rows per histogram
        by_sid: dict[int, list[tuple]] = {}
        for row in hist:
            by_sid.setdefault(row["sid"], []).append((row["b"], row["n"], row["mn"], row["mx"]))
        for key, s in active:
            hid = hists[(key[0], s["lo"], s["hi"])]
            target = key[1] - s["below"]
            acc = 0
            for b, n, mn, mx in sorted(by_sid.get(hid, [])):
                if acc + n > target:
                    s["below"] += acc
                    s["lo"], s["hi"] = mn, mx
                    break
                acc += n
            if _same(s["lo"], s["hi"]):
                s["value"] = s["lo"]
    return {c: {r: searches[(c, r)]["value"] for r in ranks[c]} for c in cols}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    profile: dict | None = None) -> dict[str, list[float | None]]:
    """{column: [quantile for each prob]} over non-null values, exact, with
    linear interpolation between order statistics."""
    cols = list(cols)
    prof = profile or column_profile(df, cols)
    want = {}
    for c in cols:
        n = prof[c][0]
        if n:
            want[c] = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    stats = exact_order_stats(df, want, prof) if want else {}
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = prof[c][0]
        res = []
        for p in probs:
            if not n:
                res.append(None)
                continue
            pos = p * (n - 1)
            a, b = stats[c][math.floor(pos)], stats[c][math.ceil(pos)]
            frac = pos - math.floor(pos)
            res.append(a + (b - a) * frac if frac else a)
        out[c] = res
    return out


def _same(lo: float, hi: float) -> bool:
    return lo == hi or lo != lo  # a range that starts at NaN holds nothing else


def _bin(v: Column, lo: float, hi: float, by_magnitude: bool) -> Column:
    """Bin 0..BINS-1 of a value in lo..hi (lo < hi), never falling as v grows:
    equal widths, or equal widths of the signed logarithm.  Infinite and NaN
    ends are split off first."""
    if math.isinf(hi) or math.isnan(hi):
        return F.when(v == F.lit(hi), F.lit(1)).otherwise(F.lit(0))
    if math.isinf(lo):
        return F.when(v == F.lit(lo), F.lit(0)).otherwise(F.lit(1))
    if by_magnitude:
        to = lambda x: math.copysign(math.log(abs(x)) + LOG_SHIFT, x) if x else 0.0
        v = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + LOG_SHIFT))
        lo, hi = to(lo), to(hi)
    by = 1e20 if max(abs(lo), abs(hi)) < 1e280 and hi - lo < 1e-280 else 0.5  # neither under- nor overflow
    width = (hi * by - lo * by) / BINS
    if width <= 0:
        return F.lit(0)
    b = F.floor((v * by - F.lit(lo * by)) / F.lit(width)).cast("int")
    return F.least(F.greatest(b, F.lit(0)), F.lit(BINS - 1))
