"""Every query with a DuckDB twin matches it (sf0.001; the driver checks sf0.01)."""

import math

import pandas as pd
import pytest

import __spark_entry__ as E
from datapaths import SF_SMALL

SQL = E.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


def test_every_query_registered_has_callable():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 100


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = duck.sql(SQL[name]).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["asset_id", "day", "status", "n_rows", "avg_feed_roll_mean", "avg_level_zscore",
                          "avg_grade", "avg_recovery"]
