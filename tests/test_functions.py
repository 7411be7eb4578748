"""Scalar expressions and their traps."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tally.functions import (clean_text, concat_strict, day_bucket, drop_suffix, gap_hours,
                             inf_to_null, lower_names, monday_floor, not_in_keep_null,
                             parse_mdy_hms, ratio_r, rename_columns, saturday_floor, to_double,
                             week_number, yymmdd)


def test_t2_concat_and_anti_set(spark):
    df = spark.createDataFrame([("A", None, "PTH"), ("A", "u", None), ("A", "u", "BMT")],
                               "a string, b string, division string")
    out = df.select(concat_strict("a", "b", "a", sep="_").alias("id"),
                    not_in_keep_null("division", ["PTH", "RIT"]).alias("keep")).collect()
    assert [r.id for r in out] == [None, "A_u_A", "A_u_A"]
    assert [r.keep for r in out] == [False, True, True]


def test_t5_ratio(spark):
    df = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (5.0, None), (-5.0, 0.0), (6.0, 3.0),
                                (None, 0.0)], "n double, d double")
    out = [r.r for r in df.select(inf_to_null(ratio_r("n", "d")).alias("r")).collect()]
    assert out[0] is None
    assert math.isnan(out[1])
    assert out[2] is None
    assert out[3] == float("-inf")
    assert out[4] == 2.0
    assert out[5] is None


def test_t6_t8_to_double(spark):
    df = spark.createDataFrame([(" 0007 ",), ("x",), ("NaN",), ("NA",), ("",), (None,), ("12.5",)],
                               "s string")
    out = [r.v for r in df.select(to_double("s").alias("v")).collect()]
    assert out == [7.0, None, None, None, None, None, 12.5]


def test_t8_parse(spark):
    df = spark.createDataFrame([("05/06/2022 00:00:00",), ("5/6/2022 3:04:05",), ("garbage",),
                                ("2022-05-06 00:00:00",), (None,)], "s string")
    out = df.select(parse_mdy_hms("s").alias("t"))
    assert dict(out.dtypes)["t"] == "timestamp_ntz"
    assert [r.t for r in out.collect()] == [dt.datetime(2022, 5, 6), dt.datetime(2022, 5, 6, 3, 4, 5),
                                            None, None, None]


def test_clean_text(spark):
    df = spark.createDataFrame([("  a ",), ("NA",), (" ",)], "s string")
    assert [r.v for r in df.select(clean_text("s").alias("v")).collect()] == ["a", None, None]


def test_t11_week_number_and_floors(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 12, 28, 5),), (dt.datetime(2020, 1, 6, 23),),
                                (dt.datetime(2024, 1, 7, 10),)], "t timestamp_ntz")
    out = df.select(week_number("t").alias("w"), monday_floor("t").alias("m")).collect()
    assert [r.w for r in out] == [52, 1, 1]
    assert [r.m for r in out] == [dt.datetime(2020, 12, 28), dt.datetime(2020, 1, 6), dt.datetime(2024, 1, 1)]


def test_saturday_floor_and_label(spark):
    df = spark.createDataFrame([(dt.date(2022, 5, 6),), (dt.date(2022, 5, 7),), (dt.date(2022, 5, 8),)], "d date")
    out = df.select(yymmdd(saturday_floor("d")).alias("f")).collect()
    assert [r.f for r in out] == ["220430", "220507", "220507"]


def test_t12_gap_hours(spark):
    t0 = dt.datetime(2024, 1, 2, 1, 0)
    rows = [(t0, t0 - dt.timedelta(hours=12)), (t0, t0 - dt.timedelta(hours=12, minutes=30)),
            (t0, t0 - dt.timedelta(hours=13)), (t0, None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, p timestamp_ntz")
    tr = [r.g for r in df.select(gap_hours("t", "p").alias("g")).collect()]
    fl = [r.g for r in df.select(gap_hours("t", "p", "floor").alias("g")).collect()]
    assert tr == [-12, -12, -13, None]
    assert fl == [-12, -13, -13, None]


def test_day_bucket(spark):
    rows = [(dt.datetime(2024, 1, 6, 3),), (dt.datetime(2024, 1, 8, 9),), (dt.datetime(2024, 1, 8, 19),),
            (dt.datetime(2024, 1, 7, 12),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    assert [r.b for r in df.select(day_bucket("t").alias("b")).collect()] == \
        ["weekend", "weekday_am", "weekday_pm", "weekend"]


def test_name_projections(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`C/A` int, Unit int, station_NEW int")
    df = rename_columns(lower_names(df), {"c/a": "c_a"})
    assert df.columns == ["c_a", "unit", "station_new"]
    assert drop_suffix(df, "_New").columns == ["c_a", "unit"]
