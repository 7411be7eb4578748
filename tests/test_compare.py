"""Baseline ratios (T5), Inf to null, names with and without fallback."""

import datetime as dt
import math

from tally.config import RunConfig
from tally.operators import baseline_ratio
from tally.schemas import BASELINE, WEEKLY
from tests.conftest import frame

WD = dt.datetime(2024, 1, 8)
STATIONS = "station string, linename string, station_new string, linename_new string, borough string"


def test_d9(spark):
    weekly = frame(spark, [("L", "S", WD, 2, 5.0, 0.0, 5.0), ("L", "X", WD, 2, 1.0, 1.0, 1.0)], WEEKLY)
    base = frame(spark, [("L", "S", 2, 0.0, 0.0, None), ("L", "X", 2, 2.0, 4.0, 0.5)], BASELINE)
    stations = frame(spark, [("S", "L", "S St", "l", "M")], STATIONS)
    out = baseline_ratio(weekly, base, stations, RunConfig())
    assert "station_new" not in out.columns and "borough" in out.columns
    assert {"weekend_2022", "weekend_bl", "d_weekend"} <= set(out.columns)
    rows = {r.borough: r for r in out.collect()}
    s = rows["M"]
    assert (s.station, s.linename) == ("S St", "l")
    assert s.d_weekend is None                      # 5/0 = Inf -> null
    assert math.isnan(s.d_weekday_am)               # 0/0 = NaN stays
    assert s.d_weekday_pm is None                   # 5/null
    x = rows[None]
    assert (x.station, x.linename) == (None, None)  # no lookup match, no fallback
    assert (x.d_weekend, x.d_weekday_am, x.d_weekday_pm) == (0.5, 0.25, 2.0)
    fb = baseline_ratio(weekly, base, stations, RunConfig(fallback_names=True))
    assert sorted(r.station for r in fb.collect()) == ["S St", "X"]
