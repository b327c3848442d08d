"""Model fits against closed forms / baselines; streams against batch twins."""

import numpy as np
from pyspark.sql import functions as F

from datapaths import SF_MED
from ridgeline.operators import ml as ML
from ridgeline.operators import predictions as PR
from ridgeline.plans import q_ml
from ridgeline.sources import tables as T
from ridgeline.streaming import live as L


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    n, k = 2000, 4
    X = rng.normal(size=(n, k)) * [1, 2, 3, 4]
    y = X @ [0.5, -1.0, 2.0, 0.1] + 3 + rng.normal(scale=0.5, size=n)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)],
                               [f"x{i}" for i in range(k)] + ["label"])
    alpha = 10.0
    sd = float(np.std(y, ddof=1))
    m = ML.fit_pipeline(df, [f"x{i}" for i in range(k)], ML.ridge(alpha, n, sd))
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(k), Xc.T @ yc)
    assert np.allclose(m.stages[-1].coefficients.toArray(), w, atol=1e-6)


def test_forest_and_boosting_beat_mean_on_planted_signal(spark):
    rng = np.random.default_rng(5)
    n = 3000
    X = rng.uniform(-2, 2, size=(n, 3))
    y = np.sin(X[:, 0]) * 3 + X[:, 1] ** 2 + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)], ["a", "b", "c", "label"])
    for est in (ML.random_forest(q_ml.QUICK_RF | {"max_features": "all"}), ML.gbt(q_ml.QUICK_GBT)):
        m = ML.fit_pipeline(df, ["a", "b", "c"], est)
        r2 = PR.regression_metrics(m.transform(df).withColumn("g", F.lit(1)), ["g"], y="label").first()["r2"]
        assert r2 > 0.8


def test_training_split_is_time_ordered(spark):
    d = q_ml.training_frame(spark, SF_MED)
    b = {r["split"]: (r["lo"], r["hi"]) for r in d.groupBy("split").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()}
    assert b["train"][1] <= b["validation"][0] and b["validation"][1] <= b["test"][0]


def _rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def _thirds(r):
    return [r.filter(f"seq % 3 = {i}") for i in range(3)]


def test_drift_from_epochs_equals_batch_and_a_replay_changes_nothing(spark, tmp_path):
    r = T.readings(spark, SF_MED)
    folder = str(tmp_path / "drift")
    for epoch, part in enumerate(_thirds(r)):
        L.drift_epoch(part, epoch, folder)
    want = _rounded(PR.prediction_drift(T.preds(r)))
    assert _rounded(L.drift_table(spark, folder)) == want
    L.drift_epoch(_thirds(r)[1], 1, folder)  # the batch is run again
    assert _rounded(L.drift_table(spark, folder)) == want
    assert spark.read.parquet(folder + "/log").count() == T.preds(r).count()


def test_stream_drift_equals_batch(spark):
    folder = L.drift_monitor(L.live_readings(spark, SF_MED))
    assert _rounded(L.drift_table(spark, folder)) == _rounded(PR.prediction_drift(T.preds(T.readings(spark, SF_MED))))


def test_stream_accuracy_equals_batch_and_a_replay_changes_nothing(spark):
    folder = L.accuracy_monitor(L.live_readings(spark, SF_MED))
    r = T.readings(spark, SF_MED)
    pairs = PR.due_pairs(T.preds(r).drop("ts"), r.select("asset_id", "ts", T.P.grade_estimate().alias("actual")))
    want = _rounded(PR.accuracy_by(pairs, ["horizon"]))
    assert len(want) == 4 and _rounded(L.accuracy_table(spark, folder)) == want
    logged = spark.read.parquet(folder + "/pairs")
    assert logged.count() == pairs.count()
    epoch = logged.agg(F.max("epoch")).first()[0]
    again = spark.createDataFrame(logged.filter(F.col("epoch") == epoch).drop("epoch").collect(), logged.drop("epoch").schema)
    L.accuracy_epoch(again, epoch, folder)
    assert _rounded(L.accuracy_table(spark, folder)) == want
    one, two = pairs.filter("seq % 2 = 0"), pairs.filter("seq % 2 = 1")
    assert _rounded(PR.merged_accuracy(PR.accuracy_parts(one, ["horizon"]).unionByName(PR.accuracy_parts(two, ["horizon"])), ["horizon"])) == want


def test_foreign_model_udf_is_arrow_batched_and_exact(spark):
    from ridgeline.plans import q_ml as QM
    df = QM.foreign_score(spark, SF_MED)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
    got = df.toPandas().set_index("seq").sort_index()
    x = (QM.kfin(spark, SF_MED).select("seq", *QM.FOREIGN.features).toPandas()
         .set_index("seq").sort_index().fillna(QM.FOREIGN_DEFAULTS))
    exp = QM.FOREIGN.predict(x[QM.FOREIGN.features]).round(6)
    assert len(got) == len(x)
    assert (got["foreign_prediction"].to_numpy() == exp).all()


def test_ring_buffer_carries_across_epochs_with_a_hot_asset(spark, tmp_path):
    """Uneven batches, one asset with most rows, chunks far smaller than it: equal to W4 over everything; a replay changes nothing."""
    from pyspark.sql import Window
    rows = [(i % 7 if i % 10 == 0 else 3, i, float(i * 37 % 101), float(i * 11 % 61)) for i in range(700)]
    df = spark.createDataFrame(rows, "asset_id long, seq long, kex double, sipx double").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    folder = str(tmp_path / "ring")
    for epoch, (lo, hi) in enumerate(((0, 1), (1, 3), (3, 320), (320, 321), (321, 700))):
        batch = df.filter((F.col("seq") >= lo) & (F.col("seq") < hi))
        L.ring_epoch(batch, epoch, folder, chunk_rows=50)
        if epoch in (2, 3):
            L.ring_epoch(batch, epoch, folder, chunk_rows=50)
    want = df.select("seq", *L._w4_lags(Window.partitionBy("asset_id").orderBy("ts", "seq")))
    assert _rounded(spark.read.parquet(folder + "/lags").drop("epoch").select(want.columns)) == _rounded(want)
    buffer = spark.read.parquet(folder + "/buffer/0")
    assert buffer.groupBy("asset_id").count().agg(F.max("count")).first()[0] == L.RING
    assert buffer.filter("asset_id = 3").agg(F.max("seq")).first()[0] == df.filter("asset_id = 3").agg(F.max("seq")).first()[0]


def test_time_folds_leave_no_row_out(spark):
    """998 rows, three folds: the remainder trains first, the last row is tested."""
    from ridgeline.operators import ml, windows
    df = spark.range(998).selectExpr("id as seq", "timestamp_seconds(id) as ts")
    got = {(r.fold, r.role): r.n_rows for r in windows.time_split_summary(df, ["ts", "seq"], 3).collect()}
    assert got == {(f, r): n for f, before in enumerate((251, 500, 749)) for r, n in (("train", before), ("test", 249))}
    folds = ml.expanding_folds(df.withColumnRenamed("seq", "_gpos"), 3)
    assert [(a.count(), b.count()) for a, b in folds] == [(251, 249), (500, 249), (749, 249)]


def test_model_queries_search_every_family(spark, monkeypatch):
    """Grids of small trees: all draws of all families in five folds, the best one refitted and registered."""
    import json
    from datapaths import SF_SMALL
    assert [len(ML.candidates(f)) for f in ML.FAMILIES] == [7, 10, 10]
    assert all(p["n_estimators"] >= 200 for f in ML.FAMILIES[1:] for p in ML.candidates(f))
    monkeypatch.setattr(ML, "RF_GRID", {"n_estimators": [2, 3], "max_depth": [2], "min_samples_split": [2, 5, 10]})
    monkeypatch.setattr(ML, "XGB_GRID", {"n_estimators": [2, 3], "max_depth": [2], "reg_alpha": [0, 0.1, 0.5]})
    monkeypatch.setattr(q_ml, "HORIZON_ROWS", {5: 1})
    got = q_ml.cv_search(spark, SF_SMALL).collect()
    assert {(r.model, r.candidate) for r in got} == {(f, i) for f, n in zip(ML.FAMILIES, (7, 10, 10)) for i in range(n)}
    assert all(r.folds == ML.CV_FOLDS == 5 for r in got)
    best = {f: max((r for r in got if r.model == f), key=lambda r: (r.mean_r2, -r.candidate)).params for f in ML.FAMILIES}
    rf = q_ml.train_rf(spark, SF_SMALL).collect()
    assert {r.params for r in rf} == {best["random_forest"]} and len(rf) == 3
    row = q_ml.model_registry_fit(spark, SF_SMALL).first()
    assert row.model_type in ML.FAMILIES and row.params == best[row.model_type]
    assert row.val_r2 >= next(r.r2 for r in rf if r.split == "validation")
