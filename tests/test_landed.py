"""Landed files: mixed separators, file order of ties, counts of cells that don't parse, one scan of many files."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tally.config import MDY_HMS, USUAL_MDY_HMS, RunConfig
from tally.functions import parse_mdy_hms
from tally.operators.deltas import clean_deltas, raw_deltas
from tally.plans.backfill import run_landed_week
from tally.plans.e2e import WEEK1
from tally.schemas import SNAPSHOT
from tally.sources.readings import PLACE, observed, read_landed, read_readings
from tests.conftest import frame
from tests.test_streaming import CFG, _tiny

HEADER = "C/A,UNIT,SCP,STATION,LINENAME,DIVISION,DATE,TIME,DESC,ENTRIES,EXITS\n"


def _file(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(HEADER + "".join(f"A,{u},0,S,L,{d},{day},{t},REGULAR,{e},0\n" for u, d, day, t, e in rows))
    return path


def test_dates_with_any_separators(spark):
    at = dt.datetime(2022, 5, 6, 4, 0, 0)
    good = ["05/06/2022 04:00:00", "05-06-2022 04:00:00", "5.6.2022 4:0:0", "5 6 2022 4 0 0", "05/06/2022T04.00.00".replace("T", " "), " 5/6/2022  4:0:00 ", "(5/6/2022) 04-00-00", "5–6–2022 4:0:0"]
    odd = [("05/06/2022 04:00:00.25", at.replace(microsecond=250000)), ("12/31/2023 23:59:59", dt.datetime(2023, 12, 31, 23, 59, 59)), ("2/29/2024 0:0:0", dt.datetime(2024, 2, 29))]
    bad = ["", "garbage", "2022-05-06 04:00:00", "13/06/2022 04:00:00", "2/30/2022 04:00:00", "05/06/2022", "05/06/2022 04:00", "5/6/2022 25:00:00", "5/6/2022 4:61:00",
           "a5/6/2022 4:0:0", "5/6/2022 4:0:0 x", "5x6/2022 4:0:0", "105/6/2022 4:0:0", "!2022-05-06 04:00:00", None]
    df = spark.createDataFrame([(s,) for s in [*good, *(s for s, _ in odd), *bad]], "s string")
    got = [r[0] for r in df.select(parse_mdy_hms("s")).collect()]
    assert got == [at] * len(good) + [t for _, t in odd] + [None] * len(bad)
    plan = df.select(parse_mdy_hms("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("timestamp_ntz") == 1 and "gettimestamp" not in plan.lower() and "to_timestamp" not in plan.lower()


def test_usual_dates_are_parsed_as_all_others(spark):
    """Cells of the public form are put in order by position: same times, and nulls, as by the pattern's groups; only others run it."""
    texts = ["05/06/2022 04:00:00", "02/29/2024 23:59:59", "02/29/2023 00:00:00", "00/10/2024 00:00:00", "13/01/2024 00:00:00", "12/31/2024 24:00:00",
             "01/01/0000 00:00:00", "01/01/0001 00:00:00", "12/31/9999 23:59:60", "05/06/2022 04:00:00\n", "\n05/06/2022 04:00:00", "٠5/06/2022 04:00:00",
             "05/06/2022 04:00:0", "05/06/2022 04:00:00.5", "05/06/20222 04:00:00", "5/06/2022 04:00:00", None, ""]
    by_groups = F.regexp_replace(F.concat(F.lit("!"), "s"), F.lit(MDY_HMS), F.lit("$3-$1-$2 $4:$5:$6")).try_cast("timestamp_ntz")
    df = spark.createDataFrame([(s,) for s in texts], "s string").select("s", parse_mdy_hms("s").alias("t"), by_groups.alias("g"))
    assert [r.s for r in df.where(~F.col("t").eqNullSafe(F.col("g"))).collect()] == []
    assert df.where("t is not null").count() >= 5
    usual = spark.range(1).select(F.lit(texts[0]).rlike(USUAL_MDY_HMS), F.lit(texts[9]).rlike(USUAL_MDY_HMS), F.lit(texts[11]).rlike(USUAL_MDY_HMS)).first()
    assert tuple(usual) == (True, False, False)


def test_cells_that_do_not_parse_are_counted(spark):
    root = tempfile.mkdtemp(prefix="tally-bad-")
    path = _file(f"{root}/readings_240113.txt", [
        ("U1", "BMT", "01/13/2024", "00:00:00", "100"), ("U1", "BMT", "01-13-2024", "04:00:00", "0110"), ("U1", "BMT", "13/13/2024", "08:00:00", "120"),
        ("U1", "BMT", "NA", "12:00:00", "130"), ("U1", "BMT", "01/13/2024", "noon", "x"), ("U1", "BMT", "01/13/2024", "16:00:00", "NA"),
        ("U1", "BMT", "01/13/2024", "20:00:00", "1,5".replace(",", ";")), ("U1", "PTH", "bad", "bad", "bad")])
    df, seen = observed(read_readings(spark, path, CFG, flags=True))
    assert df.columns == ["id", "datetime", "station", "linename", "entries"]
    assert df.count() == 7 and seen.get == {"datetime": 2, "entries": 2}
    st, stations, base = _tiny(spark, root)
    res = run_landed_week(spark, st, WEEK1, path, stations, base, CFG)
    assert res.unparsed == {"datetime": 2, "entries": 2} == st.entry(spark, "runs", WEEK1)["unparsed"]


@pytest.mark.parametrize("values", [(110, 105), (105, 110)])
def test_tied_readings_are_in_file_order(spark, values):
    """Two readings of one instant: their differences follow the file, whichever is larger."""
    cfg = RunConfig(file_order=True, split_hot=False)
    root = tempfile.mkdtemp(prefix="tally-order-")
    tied = [("U1", "BMT", "01/13/2024", "04:00:00", v) for v in values]
    path = _file(f"{root}/readings_240113.txt", [("U1", "BMT", "01/13/2024", "00:00:00", 100), *tied, ("U1", "BMT", "01/13/2024", "08:00:00", 120)])
    prior = frame(spark, [("A_U1_0", dt.datetime(2024, 1, 12, 20), 90.0, "S", "L")], SNAPSHOT)
    for hot in (None, 3):
        c = cfg.with_(hot_ranges=hot)
        raw = raw_deltas(prior, read_readings(spark, path, c), c)
        got = {(r.entries, r.d_entries) for r in raw.collect()}
        a, b = map(float, values)
        assert got == {(90.0, None), (100.0, 10.0), (a, a - 100), (b, b - a), (120.0, 120 - b)}
        assert clean_deltas(raw, None, c).count() == {110: 2, 105: 3}[values[0]]


def test_file_order_holds_over_splits(spark):
    """Many ties in a file that is read in several splits, and in a second file after it."""
    root = tempfile.mkdtemp(prefix="tally-splits-")
    order = [(i * 7919) % 5000 for i in range(5000)]
    a = _file(f"{root}/a_240113.txt", [("U1", "BMT", "01/13/2024", "04:00:00", v) for v in order[:4000]])
    b = _file(f"{root}/b_240113.txt", [("U1", "BMT", "01/13/2024", "04:00:00", v) for v in order[4000:]])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cfg = RunConfig(file_order=True, split_hot=False)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        df = read_readings(spark, [b, a], cfg)
        assert df.rdd.getNumPartitions() > 4
        raw = raw_deltas(None, df, cfg)
        got = [r.entries for r in raw.orderBy(F.col(PLACE)).collect()]
        deltas = {(r.entries, r.d_entries) for r in raw.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [float(v) for v in order]
    assert deltas == {(float(order[0]), None)} | {(float(y), float(y - x)) for x, y in zip(order, order[1:])}


def test_files_of_many_weeks_are_one_scan(spark):
    root = tempfile.mkdtemp(prefix="tally-weeks-")
    week = dt.timedelta(days=7)
    files = {WEEK1 + i * week: _file(f"{root}/in put/readings_{WEEK1 + i * week:%y%m%d}.txt", [(f"U{i}", "BMT", "01/13/2024", "04:00:00", i)] * (i + 1)) for i in range(4)}
    df = read_landed(spark, files, CFG)
    assert sorted((r.id, r.run) for r in df.collect()) == sorted((f"A_U{i}_0", WEEK1 + i * week) for i in range(4) for _ in range(i + 1))
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan csv") == 1
    assert read_landed(spark, {}, CFG).collect() == []
