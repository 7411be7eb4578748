"""Counted rows against expanded ones, and all weeks in one plan against the weeks run one by one."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.operators.counted import COPIES, count_copies, counted_clean, counted_raw, counted_snapshot, counted_weekly, expand
from tally.operators.deltas import clean_deltas, raw_deltas
from tally.operators.snapshot import next_snapshot
from tally.operators.weekly import time_bucket, weekly_counts
from tally.plans.history import run_history
from tally.plans.week import run_week
from tally.schemas import READINGS, SNAPSHOT, WEEKLY
from tally.session import written
from tests.conftest import frame

CFG = RunConfig(split_hot=False)
STATIONS = "station string, linename string, station_new string, linename_new string"
MON = dt.datetime(2024, 1, 6, 8)


def rows(df, digits=6):
    def cell(x):
        return round(x, digits) if isinstance(x, float) else x
    return sorted(str(tuple(cell(x) for x in r)) for r in df.collect())


def scenario(rng, weeks=4, ids=9):
    """Prior rows (tied, null, repeated), readings by week with ties, nulls, gaps and counters that come and go."""
    names = [("S1", "L"), ("S2", "L"), ("S3", "M")]

    def readings(i, start, n):
        out, total = [], rng.randint(0, 500)
        way = rng.choice([1, 1, -1])
        t = start
        for _ in range(n):
            t += dt.timedelta(hours=rng.choice([0, 1, 2, 4, 4, 13]))
            total += way * rng.choice([0, 1, 5, 5, 7, 20000 if rng.random() < 0.05 else 3])
            out.append((f"c{i}", None if rng.random() < 0.01 else t, *names[i % 3 if rng.random() < 0.97 else 0], float(total) if rng.random() < 0.97 else None))
        return out
    prior = []
    for i in range(ids):
        if rng.random() < 0.7:
            one = (f"c{i}", MON - dt.timedelta(hours=rng.randint(0, 30)) if rng.random() < 0.95 else None, float(rng.randint(0, 500)), *names[i % 3])
            prior += [one] * rng.choice([1, 1, 1, 2])
            if rng.random() < 0.2:
                prior.append((one[0], one[1], one[2] + rng.choice([0, 1]), *rng.choice(names)))
            if rng.random() < 0.1 and one[1] is not None:
                prior.append((one[0], one[1] - dt.timedelta(hours=1), one[2], *names[i % 3]))
    weekly = []
    for w in range(weeks):
        got = []
        for i in range(ids):
            if rng.random() < 0.75:
                got += readings(i, MON + dt.timedelta(days=7 * w, hours=rng.randint(0, 90)), rng.choice([1, 3, 6, 12, 20]))
        weekly.append(got)
    old = [("L", "S1", dt.datetime(2024, 1, 1), 1, 5.0, None, 7.0), ("L", "S1_ST", dt.datetime(2024, 1, 8), 2, 50.0, 60.0, 70.0), ("M", "S3", dt.datetime(2024, 1, 8), 2, None, 1.0, None)]
    return prior, weekly, old


def stations_of(spark):
    return frame(spark, [("S1", "L", "S1_ST", "l"), ("S3", "M", "S3_ST", "m")], STATIONS)


@pytest.mark.parametrize("seed", range(3))
def test_counted_operators_expand_to_the_plain_ones(spark, seed):
    prior, weekly, _ = scenario(random.Random(seed), weeks=1)
    prior = [r for r in prior for _ in range(random.Random(str(r)).choice([1, 1, 2, 3, 6]))]
    p, latest, st = frame(spark, prior, SNAPSHOT), frame(spark, weekly[0], READINGS), stations_of(spark)
    counted = count_copies(p)
    raw, craw = raw_deltas(p, latest, CFG), counted_raw(counted, latest, CFG)
    clean, cclean = clean_deltas(raw, None, CFG), counted_clean(craw, CFG)
    assert rows(expand(cclean).select(*clean.columns)) == rows(clean)
    split = CFG.with_(hot_ranges=5)
    assert rows(expand(counted_clean(counted_raw(counted, latest, split), split)).select(*clean.columns)) == rows(clean)
    first = CFG.with_(keep_first_interval=True)
    assert rows(expand(counted_clean(craw, first)).select(*clean.columns)) == rows(clean_deltas(raw, None, first))
    snap, new = next_snapshot(raw, p, latest, st, CFG)
    csnap, cnew = counted_snapshot(craw, counted, latest, st, CFG)
    assert rows(expand(csnap).select(*snap.columns)) == rows(snap) and (new is None) == (cnew is None)
    plain = weekly_counts(time_bucket(clean, CFG), snap, CFG)
    assert rows(counted_weekly(time_bucket(cclean, CFG), csnap).select(*plain.columns)) == rows(plain)


def test_many_copies_are_one_row(spark):
    """65,536 copies of a reading, and what six runs without it make of two, stay one row."""
    one = ("c", MON, 5.0, "S2", "L")
    counted = spark.createDataFrame([(*one, 65536.0)], "id string, datetime timestamp_ntz, entries double, station string, linename string, copies double")
    nothing = frame(spark, [], READINGS)
    snap, _ = counted_snapshot(counted_raw(counted, nothing, CFG), counted, nothing, stations_of(spark), CFG)
    assert [(r.id, r.copies) for r in snap.collect()] == [("c", 65536.0 ** 2)]
    runs = [dt.date(2024, 1, 6) + dt.timedelta(days=7 * i) for i in range(6)]
    two = frame(spark, [one, one], SNAPSHOT)
    readings = nothing.withColumn("run", F.lit(None).cast("date"))
    got = run_history(readings, runs, two, frame(spark, [], WEEKLY), stations_of(spark), CFG)
    assert [(r.id, r.copies) for r in got.snapshot.collect()] == [("c", 2.0 ** 64)]
    snap = count_copies(two)
    for _ in runs:
        snap, _ = counted_snapshot(counted_raw(snap, nothing, CFG), snap, nothing, stations_of(spark), CFG)
        snap = written(snap)
        assert snap.count() == 1
    assert snap.first()[COPIES] == 2.0 ** 64


def test_counted_runs_through_a_store(spark):
    """Two landed weeks with ``counted_copies`` hold the same state, counted; a plain run can go on from it."""
    from tally.plans.backfill import backfill
    from tally.sources.store import Store
    from tests.test_streaming import WEEK1, WEEK2, _land, _tiny
    root = tempfile.mkdtemp(prefix="tally-counted-")
    week = dt.timedelta(days=7)
    tied = [("A_U1_0", dt.datetime(2024, 1, 12, 20), 90.0, "S", "L")] * 2 + [("A_U9_0", dt.datetime(2024, 1, 12, 20), 5.0, "S", "L")] * 3
    out = []
    for name, cfg in (("plain", CFG), ("counted", CFG.with_(counted_copies=True))):
        st, stations, base = _tiny(spark, f"{root}/{name}")
        st.write(frame(spark, tied, SNAPSHOT), "snapshots", WEEK1 - week)
        files = {w: _land(f"{root}/{name}/landing", f"readings_{w:%y%m%d}.txt", w, "U1") for w in (WEEK1, WEEK2)}
        assert backfill(spark, st, files, stations, base, cfg) == [WEEK1, WEEK2]
        out.append((st, stations, base))
    (a, stations, base), (b, _, _) = out
    for w in (WEEK1, WEEK2):
        assert rows(expand(b.read(spark, "snapshots", w)).select(*SNAPSHOT.fieldNames())) == rows(a.read(spark, "snapshots", w, SNAPSHOT))
        assert rows(b.read(spark, "weekly", w, WEEKLY)) == rows(a.read(spark, "weekly", w, WEEKLY))
    assert b.read(spark, "snapshots", WEEK2).count() == 2 and a.read(spark, "snapshots", WEEK2).count() == 81 + 2
    w3 = WEEK2 + week
    for st in (a, b):
        backfill(spark, st, {w3: _land(f"{st.root}/landing", f"readings_{w3:%y%m%d}.txt", w3, "U2")}, stations, base, CFG)
    assert rows(a.read(spark, "snapshots", w3, SNAPSHOT).groupBy("id").count()) == rows(b.read(spark, "snapshots", w3, SNAPSHOT).groupBy("id").count())


@pytest.mark.parametrize("seed", range(4))
def test_one_plan_equals_the_weeks_run_one_by_one(spark, seed):
    prior, weekly, old = scenario(random.Random(100 + seed))
    runs = [dt.date(2024, 1, 6) + dt.timedelta(days=7 * i) for i in range(len(weekly))]
    st, base = stations_of(spark), frame(spark, [], "linename string, station string, week int, weekend double, weekday_am double, weekday_pm double")
    snap, acc, each = frame(spark, prior, SNAPSHOT), frame(spark, old, WEEKLY), []
    for day, got in zip(runs, weekly):
        res = run_week(spark, CFG.with_(run_date=day), frame(spark, got, READINGS), snap, acc, st, base)
        snap = spark.createDataFrame(res.snapshot.select(*SNAPSHOT.fieldNames()).collect(), SNAPSHOT)
        acc = spark.createDataFrame(res.accumulated.select(*WEEKLY.fieldNames()).collect(), WEEKLY)
        each += [str(x) for x in rows(res.weekly.select(F.lit(day).alias("run"), *sorted(res.weekly.columns)))]
    readings = frame(spark, [(*r, day) for day, got in zip(runs, weekly) for r in got], READINGS.simpleString()[7:-1].replace(":", " ") + ", run date")
    h = run_history(readings, runs, frame(spark, prior, SNAPSHOT), frame(spark, old, WEEKLY), st, CFG)
    assert rows(expand(h.snapshot).select(*SNAPSHOT.fieldNames())) == rows(snap)
    assert rows(h.weekly.select("run", *sorted(res.weekly.columns))) == sorted(each)
    assert rows(h.accumulated.select(*WEEKLY.fieldNames())) == rows(acc)
    if not seed:  # with the readings dealt by rank, as for hot counters
        h = run_history(readings, runs, frame(spark, prior, SNAPSHOT), frame(spark, old, WEEKLY), st, CFG.with_(split_hot=True, max_rows_per_key=15))
        assert rows(expand(h.snapshot).select(*SNAPSHOT.fieldNames())) == rows(snap)
        assert rows(h.accumulated.select(*WEEKLY.fieldNames())) == rows(acc)


def test_counters_without_a_name_are_refused(spark):
    readings = frame(spark, [("c", MON, None, "L", 1.0, dt.date(2024, 1, 6))], READINGS.simpleString()[7:-1].replace(":", " ") + ", run date")
    with pytest.raises(ValueError, match="counter c has no station name"):
        run_history(readings, [dt.date(2024, 1, 6)], frame(spark, [], SNAPSHOT), frame(spark, [], WEEKLY), stations_of(spark), CFG)


def test_readings_are_exchanged_once(spark):
    """Every use of the readings reads the same exchange: the plan that runs has one scan of them."""
    import re
    root = tempfile.mkdtemp(prefix="tally-history-")
    prior, weekly, old = scenario(random.Random(5))
    runs = [dt.date(2024, 1, 6) + dt.timedelta(days=7 * i) for i in range(len(weekly))]
    frame(spark, [(*r, day) for day, got in zip(runs, weekly) for r in got], READINGS.simpleString()[7:-1].replace(":", " ") + ", run date").write.parquet(f"{root}/readings")
    scan = spark.read.parquet(f"{root}/readings")
    h = run_history(scan, runs, frame(spark, prior, SNAPSHOT), frame(spark, old, WEEKLY), stations_of(spark), CFG)
    h.weekly.collect()
    plan = h.weekly._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scans = [x for x in re.findall(r"FileScan parquet \[[^\]]*\]", plan) if "entries#" in x and "run#" in x and "station#" not in x]
    assert len(scans) == 1, scans


def test_readings_files_are_parsed_once(spark):
    """The jobs of a history read the parsed rows: what it returns doesn't scan the files again."""
    root = tempfile.mkdtemp(prefix="tally-history-")
    prior, weekly, old = scenario(random.Random(6))
    runs = [dt.date(2024, 1, 6) + dt.timedelta(days=7 * i) for i in range(len(weekly))]
    schema = READINGS.simpleString()[7:-1].replace(":", " ") + ", run date"
    frame(spark, [(*r, day) for day, got in zip(runs, weekly) for r in got], schema).write.csv(f"{root}/readings")
    h = run_history(spark.read.schema(schema).csv(f"{root}/readings"), runs, frame(spark, prior, SNAPSHOT), frame(spark, old, WEEKLY), stations_of(spark), CFG)
    for df in (h.weekly, h.accumulated, h.snapshot):
        assert not [f for f in df.inputFiles() if f"{root}/readings" in f]


def test_the_first_state_is_taken_on_the_views_partitioning(spark, tmp_path):
    """Landing computes the first week's counts once, and the first snapshot without a shuffle of the readings; ties are kept."""
    from tally.plans import e2e
    from tally.sources import testbed as tb
    t0 = dt.datetime(2024, 1, 1, 8)
    ev = [(i, t0 + dt.timedelta(hours=6 * (i // 8)), i % 5, 1.0 + i % 3) for i in range(400)] + [(900, None, 1, 2.0), (901, t0, None, 1.0)]
    frame(spark, ev, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    frame(spark, [(i, f"N{i}", i % 2) for i in range(25)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    frame(spark, [(i, f"R{i}") for i in range(2)], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    r, cfg = tb.readings_view_cfg(spark, str(tmp_path))
    start = dt.datetime(2024, 1, 6)
    assert r.count() == 401  # the view is there, its partitioning known
    got = tb.prior_snapshot(r, cfg, start)
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert got.count() > got.select("id").distinct().count()
    assert rows(got) == rows(tb.prior_snapshot(r, cfg.with_(hot_ranges=2), start))
    asked = []
    whole = e2e.weekly_from_readings

    def seen(*a, **k):
        asked.append(whole(*a, **k))
        return asked[-1]

    e2e.weekly_from_readings = seen
    try:
        w = e2e.land_all_weeks(spark, str(tmp_path), f"{tmp_path}/land")
    finally:
        e2e.weekly_from_readings = whole
    first = min(w.files) - dt.timedelta(days=7)
    assert rows(w.store.read(spark, "weekly", first).select(*WEEKLY.fieldNames())) == rows(asked[0].select(*WEEKLY.fieldNames()))
