"""The scenario search is dealt by point before it is expanded."""

from ridgeline.operators import scenario as S


def _points(spark):
    return spark.range(200).coalesce(1).selectExpr("id % 150 as seq", "2.0d + id % 7 as feed_pb", "if(id % 11 = 0, null, 30.0d + id % 40) as kex",
                                                   "20.0d + id % 9 as sipx", "8.0d + id % 5 as air_flow", "40.0d as level")


def test_points_are_dealt_once_before_the_expansion(spark):
    plan = S.best_scenario(_points(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(seq") == 1
    assert plan.index("Generate inline") < plan.index("Exchange hashpartitioning(seq")  # below it in the tree


def test_wide_stages_are_bounded_in_any_session(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        n = S.best_scenario(_points(spark)).count()
        assert n == 150 and spark.conf.get(key) == "8000"
        spark.conf.set(key, "4000")
        S.best_scenario(_points(spark))
        assert spark.conf.get(key) == "4000"
    finally:
        spark.conf.set(key, before)
