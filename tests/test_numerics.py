"""Parity with pandas / numpy for the numerically delicate operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from datapaths import SF_MED
from ridgeline.operators import clean as C
from ridgeline.operators import quantiles as Q
from ridgeline.operators import windows as W
from ridgeline.sources import tables as T


@pytest.fixture(scope="module")
def frame(spark):
    d = C.inf_to_null(T.readings(spark, SF_MED)).filter("asset_id = 1")
    return d, d.orderBy("ts", "seq").toPandas()


def test_rolling_stats_match_pandas(frame):
    d, pdf = frame
    w = Window.partitionBy("asset_id").orderBy("ts", "seq")
    got = d.select("seq", *W.rolling_basic(w, ["air_flow"]), *W.rolling_quantiles(w, ["air_flow"]),
                   *W.rolling_shape(w, ["air_flow"]), *W.rolling_zscore(w, ["air_flow"])).orderBy("seq").toPandas()
    r = pdf.set_index("seq").sort_index()["air_flow"]
    roll = pdf.sort_values(["ts", "seq"]).set_index("seq")["air_flow"].rolling(6, min_periods=1)
    exp = pd.DataFrame({"mean": roll.mean(), "std": roll.std(), "p25": roll.quantile(0.25), "skew": roll.skew(),
                        "kurt": roll.kurt()}).sort_index()
    got = got.set_index("seq").sort_index()
    assert np.allclose(got["air_flow_roll_mean_30min"], exp["mean"], atol=1e-9)
    assert np.allclose(got["air_flow_roll_std_30min"], exp["std"], atol=1e-9, equal_nan=True)
    assert np.allclose(got["air_flow_p25_30min"], exp["p25"], atol=1e-9)
    # pandas' rolling moments use an online algorithm: 1e-6 relative is its precision
    sk = got["air_flow_skew_30min"].astype(float)
    mask = sk.notna() & exp["skew"].notna() & (got["air_flow_roll_std_30min"] > 1e-6)
    assert np.allclose(sk[mask], exp["skew"][mask], rtol=1e-5, atol=1e-6)
    ku = got["air_flow_kurt_30min"].astype(float)
    mask = ku.notna() & exp["kurt"].notna() & (got["air_flow_roll_std_30min"] > 1e-6)
    assert np.allclose(ku[mask], exp["kurt"][mask], rtol=1e-5, atol=1e-5)
    _ = r


def test_exact_quantiles_refinement_matches_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(size=30001), "b": np.round(rng.uniform(0, 3, size=30001), 2)})
    pdf.loc[::5, "a"] = np.nan
    df = spark.createDataFrame(pdf).selectExpr("nanvl(a, null) as a", "b")
    res = Q.exact_quantiles(df, ["a", "b"], [0.1, 0.5, 0.9])
    for c in "ab":
        assert np.allclose(res[c], pdf[c].quantile([0.1, 0.5, 0.9]).tolist(), atol=1e-12)


def test_median_imputation_fills_every_null(spark):
    d = C.impute_median(C.inf_to_null(T.readings(spark, SF_MED)), T.TAGS)
    assert d.filter(" OR ".join(f"{c} IS NULL" for c in T.TAGS)).count() == 0


def test_dedupe_keeps_last(spark):
    r = T.readings_dup(T.readings(spark, SF_MED))
    d = C.dedupe_last(r)
    assert d.count() == T.readings(spark, SF_MED).count()
    assert d.filter("seq >= 1000000").count() == r.filter("seq >= 1000000").count()


def test_leakage_guard_drops_target_names(spark):
    r = T.readings(spark, SF_MED).withColumn("grade_5min_ahead", F.lit(1.0)).withColumn("forecast_x", F.lit(1.0))
    out = C.leakage_guard(r)
    assert not any(p in c for c in out.columns for p in C.LEAKAGE_PATTERNS)


def test_alert_rules_first_match_per_metric(spark):
    from ridgeline.operators import joins as J
    k = T.with_kpis(C.inf_to_null(T.readings(spark, SF_MED)))
    a = J.threshold_alerts(k, J.kpi_metrics())
    assert a.groupBy("seq", "metric").count().filter("count > 1").count() == 0


def test_quantile_search_fetches_counts_of_bins_only(spark, monkeypatch):
    n = 20000
    pdf = pd.DataFrame({"x": np.random.default_rng(11).normal(size=n)})
    df = spark.createDataFrame(pdf)
    cls = type(df)                      # the concrete (classic) DataFrame class
    fetched, real = [], cls.collect

    def spy(self):
        out = real(self)
        fetched.append(len(out))
        return out
    monkeypatch.setattr(cls, "collect", spy)
    monkeypatch.setattr(cls, "toPandas", lambda self: pytest.fail("values fetched"))
    monkeypatch.setattr(Q, "BINS", 64)
    probs = [i / 10 for i in range(1, 10)]
    res = Q.exact_quantiles(df, ["x"], probs)
    assert max(fetched) <= 64 * 2 * len(probs)
    assert np.allclose(res["x"], pdf["x"].quantile(probs).tolist(), atol=1e-12)


def test_order_statistics_of_any_spread(spark):
    rng = np.random.default_rng(3)
    wide = 10.0 ** rng.uniform(-300, 300, 3000) * rng.choice([-1, 1], 3000)
    cols = {"wide": wide, "ties": np.repeat([1.0, 1.0 + 2 ** -52, 7.0], 1000),
            "ends": np.concatenate([[-np.inf] * 5, rng.normal(size=2980), [np.inf] * 10, [np.nan] * 5]),
            "tiny": rng.integers(0, 50, 3000) * 5e-324, "huge": rng.choice([-1.7e308, 0.0, 1.7e308], 3000)}
    df = spark.createDataFrame(list(zip(*[x.tolist() for x in cols.values()], strict=True)), list(cols))
    ranks = [0, 1, 700, 1500, 2990, 2999]
    got = Q.exact_order_stats(df, {c: ranks for c in cols})
    for c, x in cols.items():
        assert np.array_equal([got[c][r] for r in ranks], np.sort(x)[ranks], equal_nan=True), c
