"""Plug-ins are checked before any row is read, and run inside the library's passes."""

import pytest
from datapaths import SF_SMALL
from pyspark.sql import functions as F

from ridgeline.operators import features as FT
from ridgeline.operators import plugins as PL
from ridgeline.plans.q_select import ReagentLoad
from ridgeline.plans.q_stream import GradeBands
from ridgeline.sources import tables as T


def test_processor_needs_columns_names_and_count(spark):
    r = T.readings(spark, SF_SMALL)
    with pytest.raises(PL.PluginError, match="needs columns"):
        FT.build_features(r.drop("sipx"), ["feed_pb", "kex"], processors=[ReagentLoad()])
    taken, few = ReagentLoad(), ReagentLoad()
    taken.names, few.names = ("kex", "b", "c"), ("a", "b")
    for p in (taken, few):
        with pytest.raises(PL.PluginError):
            FT.build_features(r, T.TAGS, processors=[p])


def test_processor_looks_back_over_chunks(spark):
    """Its own lookback widens the halo: small chunks give what one window gives."""
    r = T.readings(spark, SF_SMALL)
    got = [FT.build_features(r, T.TAGS, processors=[ReagentLoad()], chunk_rows=n).select("seq", *ReagentLoad.names, "features_valid").orderBy("seq").collect() for n in (15, 1 << 20)]
    assert got[0] == got[1] and any(x.features_valid for x in got[0]) and not all(x.features_valid for x in got[0])


def test_analyser_is_checked_and_unknown_statuses_are_marked(spark):
    df = spark.createDataFrame([(20.0, 0.8, 5.0), (20.0, 0.8, 0.0), (5.0, None, 1.0), (None, 0.8, 1.0)], "grade double, recovery double, kex double")
    got = [(r.status, r.in_range, r.recommendations) for r in PL.analysed(df, GradeBands()).collect()]
    assert got == [("good", True, []), (PL.UNKNOWN, True, []), ("low", False, ["Raise the grade", "Check the feed"]), (PL.UNKNOWN, False, [])]
    with pytest.raises(PL.PluginError):
        PL.analysed(df.drop("kex"), GradeBands())
    backward = GradeBands()
    backward.ranges = {"grade": (3.0, 1.0)}
    with pytest.raises(PL.PluginError):
        PL.analysed(df, backward)
    assert PL.analysed(df.filter(F.lit(False)), GradeBands()).count() == 0
