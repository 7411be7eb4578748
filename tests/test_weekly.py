"""Buckets, pivot (T10), merge (D8, T3) and the rollup's pre-aggregation."""

import datetime as dt

from tally.config import RunConfig
from tally.operators import merge_weekly, time_bucket, weekly_counts
from tally.schemas import WEEKLY
from tests.conftest import frame

CFG = RunConfig(split_hot=False)
DELTAS = "id string, datetime timestamp_ntz, d_entries double"
NAMES = "id string, station string, linename string"


def test_t10_three_bucket_columns(spark):
    sat = dt.datetime(2024, 1, 6, 3)    # Saturday, any hour counts
    d = frame(spark, [("a", sat, 4.0), ("a", sat + dt.timedelta(days=1), 6.0),
                      ("a", dt.datetime(2024, 1, 8, 3), 100.0)], DELTAS)   # Monday 3 am: dropped
    w = weekly_counts(time_bucket(d, CFG), frame(spark, [("a", "S", "L")], NAMES), CFG)
    assert w.columns == ["linename", "station", "weekdate", "weekend", "weekday_am", "weekday_pm", "week"]
    assert [tuple(r) for r in w.collect()] == [("L", "S", dt.datetime(2024, 1, 1), 10.0, None, None, 1)]


def test_rollup_fans_out_on_duplicate_names(spark):
    t = dt.datetime(2024, 1, 8, 9)
    d = frame(spark, [("a", t, 1.0), ("a", t, 2.0), ("b", t, 5.0), ("z", t, 7.0)], DELTAS)
    names = frame(spark, [("a", "S", "L"), ("a", "S", "L"), ("b", "S", "L")], NAMES)
    w = weekly_counts(time_bucket(d, CFG), names, CFG)
    got = sorted(((r.station, r.weekday_am) for r in w.collect()), key=str)
    # a's 3.0 counted twice (two snapshot rows), unknown id z lands under null names
    assert got == [("S", 11.0), (None, 7.0)]


def test_d8_merge_and_t3_null_keys(spark):
    wd = dt.datetime(2024, 1, 1)
    old = frame(spark, [(None, "S", wd, 1, None, 5.0, 6.0), ("L", "T", wd, 1, 1.0, 1.0, 1.0)], WEEKLY)
    new = frame(spark, [(None, "S", wd, 1, 3.0, None, 7.0)], WEEKLY)
    m = merge_weekly(new, old)
    got = sorted((tuple(r) for r in m.collect()), key=str)
    assert got == sorted([(None, "S", wd, 1, 3.0, 5.0, 7.0), ("L", "T", wd, 1, 1.0, 1.0, 1.0)], key=str)
    # merging the same week twice equals merging once
    m2 = merge_weekly(new, m)
    assert sorted(map(str, m2.collect())) == sorted(map(str, m.collect()))
