"""Projections, filters and cleaning.

Data-dependent steps (empty columns, medians) cost one aggregation each and
are combined where possible; everything else is a lazy projection or filter
that Catalyst pushes towards the parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators.quantiles import column_profile, exact_quantiles
from ridgeline.session import reliable_checkpoint

# --- fixed values that must equal the reference's ---------------------------
# Timestamp column candidates, tried in this order.
TS_CANDIDATES = ["Timestamp", "timestamp", "Date", "date", "DateTime", "datetime", "Time", "time"]
# Column-name fragments that mark target or future information.
LEAKAGE_PATTERNS = ["_ahead", "target", "Pb_Rougher_Conc_Pb", "future", "prediction", "forecast",
                    "shift_neg", "shift_-"]
# Valid parameter ranges (inclusive) of the five live tags.
PARAM_RANGES = {"feed_pb": (0.0, 2.55), "kex": (-2.55, 1499.97), "sipx": (-1.31, 1198.63),
                "air_flow": (3.99, 14.17), "level": (0.0, 86.50)}
# ---------------------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """S3: keep numeric columns (plus ``keep``, e.g. the time column)."""
    num = numeric_columns(df)
    return df.select(*[c for c in df.columns if c in keep or c in num])


def discover_timestamp(df: DataFrame, out: str = "ts") -> DataFrame:
    """First candidate name present, else first datetime column; text is
    parsed with ``try_to_timestamp`` (invalid -> null)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    name = next((c for c in TS_CANDIDATES if c in fields), None)
    if name is None:
        name = next((f.name for f in df.schema.fields
                     if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))), None)
    if name is None:
        raise ValueError("no timestamp column found")
    dt = fields[name]
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        c = F.col(name).cast("timestamp_ntz")
    elif isinstance(dt, T.DateType):
        c = F.col(name).cast("timestamp_ntz")
    else:
        c = F.try_to_timestamp(F.col(name).cast("string")).cast("timestamp_ntz")
    rest = [x for x in df.columns if x != name]
    return df.select(c.alias(out), *rest)


def _is_fractional(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def inf_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """+-inf (and NaN) -> null on floating columns."""
    cols = set(cols or [c for c in df.columns if _is_fractional(df, c)])
    return df.select(*[finite_or_null(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop all-null columns (one aggregation; the schema depends on data)."""
    row = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if row[f"n{i}"] > 0]
    return df.select(*keep)


def valid_rows(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Every value finite and non-null, and target > 0 when given."""
    conds = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != F.lit(float("inf")))
             if _is_fractional(df, c) else F.col(c).isNotNull() for c in cols]
    if target is not None:
        conds.append(F.col(target) > 0)
    return df.filter(reduce(lambda a, b: a & b, conds))


def leakage_guard(df: DataFrame, target: str | None = None, patterns: Sequence[str] = LEAKAGE_PATTERNS,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose name contains a future/target pattern."""
    cols = [c for c in df.columns
            if c in keep or (c != target and not any(p in c for p in patterns))]
    return df.select(*cols)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: rows with no null in ``cols``."""
    return df.dropna(how="any", subset=list(cols))


def range_scan(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Inclusive time range, newest first (filter reaches the scan)."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def range_optional(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Optional bounds; a date-only end covers its whole day (half-open)."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        end_excl = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
        df = df.filter(F.col(ts) < end_excl)
    return df


def range_violations(ranges: dict = PARAM_RANGES, present: Sequence[str] | None = None) -> Column:
    """Array of names of parameters outside their inclusive range."""
    names = [c for c in ranges if present is None or c in present]
    flags = [F.when(~F.col(c).between(ranges[c][0], ranges[c][1]), F.lit(c)) for c in names]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def validate_ranges(df: DataFrame, ranges: dict = PARAM_RANGES) -> DataFrame:
    """Add ``violations`` and ``is_valid`` (null values pass, as unknowns do)."""
    v = range_violations(ranges, df.columns)
    return df.withColumn("violations", v).withColumn("is_valid", F.size("violations") == 0)


# --- fixed values that must equal the reference's ---------------------------
# Typical values of process tags that the live feed lacks.
TAG_DEFAULTS = {
    "Pb_Rougher2_KEX_Flowrate": 30.0, "Pb_Conditioner_Nigrosine_Flowrate": 5.0, "Pb_Rougher1_Valve": 65.0,
    "Pb_Scavenger1_Valve": 60.0, "Pb_Rougher_Conc_FlowA": 80.0, "Pb_Rougher_Conc_FlowB": 75.0,
    "Pb_Final_Conc_FlowA": 85.0, "Pb_Cleaner1_Valve": 70.0, "Pb_Cleaner1_AirFlow": 100.0,
    "Pb_Cleaner1_DiluteNigrosine_Flowrate": 3.0, "Pb_Cleaner1_Nigrosine_Flowrate": 2.0, "Pb_Cleaner3_Valve": 65.0,
    "Pb_Cleaner3_DiluteNigrosine_Flowrate": 2.5, "Pb_Rougher_Conc_Pb": 25.0, "Pb_Final_Conc_Pb": 28.0,
    "Pb_Rougher2_AirFlow_roll15": 110.0,
}
# ---------------------------------------------------------------------------


def feature_contract(df: DataFrame, expected: Sequence[str], defaults: dict | None = None,
                     fill: float = 0.0, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Expected names in order; missing ones added as a constant
    (per-name default, else ``fill``); extras cut.  Returns the missing list."""
    defaults = defaults or {}
    have = set(df.columns)
    missing = [c for c in expected if c not in have]
    cols = [F.col(c) for c in keep]
    for c in expected:
        if c in have:
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(float(defaults[c]))).alias(c)
                        if c in defaults else F.col(c))
        else:
            cols.append(F.lit(float(defaults.get(c, fill))).alias(c))
    return df.select(*cols), missing


def normalise_grade(*cands: str | Column) -> Column:
    """First non-null candidate, fraction (0<v<1) -> percent, clamp 0-50."""
    v = F.coalesce(*[F.col(c) if isinstance(c, str) else c for c in cands])
    pct = F.when((v > 0) & (v < 1), v * 100.0).otherwise(v)
    return F.greatest(F.lit(0.0), F.least(F.lit(50.0), pct))


def cast_defaults(df: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """``{name: (type, default)}`` -> try_cast with a default per field."""
    out = []
    for c in df.columns:
        if c in spec:
            typ, dflt = spec[c]
            out.append(F.coalesce(F.col(c).try_cast(typ), F.lit(dflt).cast(typ)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def dedupe_last(df: DataFrame, keys: Sequence[str] = ("asset_id", "ts"), order: Sequence[str] = ("seq",)) -> DataFrame:
    """One row per key, the last by ``order`` wins.

    Expressed as ``max_by`` aggregation (hash aggregate with map-side partial
    merge) instead of a sort-based window; the shuffle key is the full
    (asset, ts) key, so no single asset lands in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), ordk).alias("_last"))
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A1: fill nulls with each column's exact median (nulls ignored)."""
    cols = list(cols or [c for c in numeric_columns(df)])
    med = exact_quantiles(df, cols, [0.5])
    return df.select(*[F.coalesce(F.col(c), F.lit(med[c][0]).cast(df.schema[c].dataType)).alias(c)
                       if c in med and med[c][0] is not None else F.col(c) for c in df.columns])


def clean_and_impute(df: DataFrame, value_cols: Sequence[str], keys=("asset_id", "ts"), order=("seq",),
                     target: str | None = None) -> DataFrame:
    """Trace A cleaning: W16 -> P2 -> P1 -> A1 -> P3.

    The deduplicated frame feeds several passes (column profile, median
    refinement rounds, the final projection); it is checkpointed once to the
    shared checkpoint folder so those passes read it instead of repeating
    the scan and the dedupe shuffle, and lineage stays short on executor loss."""
    d = dedupe_last(df, keys, order)
    d = reliable_checkpoint(inf_to_null(d, [c for c in value_cols if _is_fractional(d, c)]))
    prof = column_profile(d, list(value_cols))
    keep = [c for c in value_cols if prof[c][0] > 0]
    d = d.select(*[c for c in d.columns if c not in value_cols or c in keep])
    med = exact_quantiles(d, keep, [0.5], profile={c: prof[c] for c in keep})
    d = d.select(*[F.coalesce(F.col(c), F.lit(med[c][0])).alias(c) if c in med else F.col(c)
                   for c in d.columns])
    return valid_rows(d, keep, target)
