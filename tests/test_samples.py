"""Stratified samples have exact bin sizes, also where hashes tie."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import tables_ops as TO


@pytest.mark.parametrize("key", [("seq",), ("same",), ("few",)])
@pytest.mark.parametrize("frac", [0.0, 0.1, 0.5, 1.0])
def test_bin_sizes_are_exact(spark, key, frac):
    df = spark.range(330).selectExpr("id as seq", "id % 3 * (id % 2) as bin", "1 as same", "id % 4 as few")
    out = TO.sample_stratified(df, "bin", frac, key=key)
    assert out.columns == df.columns and out.select("seq").distinct().count() == out.count()
    want = {r["bin"]: int(r["count"] * frac + 0.5) for r in df.groupBy("bin").count().collect()}
    got = {r["bin"]: r["count"] for r in out.groupBy("bin").count().collect()}
    assert got == {b: n for b, n in want.items() if n}
    if key == ("seq",):
        hashed = df.withColumn("h", TO._hash52(key, 42))
        for b, n in want.items():
            first = [r.seq for r in hashed.filter(F.col("bin") == b).orderBy("h").limit(n).collect()]
            assert {r.seq for r in out.filter(F.col("bin") == b).collect()} == set(first)
