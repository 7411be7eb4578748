"""Two consecutive runs through the versioned store, plan shape, oracle gate."""

import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tally.plans.catalog import QUERIES
from tally.plans.e2e import WEEK1, WEEK2, two_week_run
from tally.plans.oracle import ORACLE
from tally.schemas import SNAPSHOT, WEEKLY
from tally.sources.store import Store
from tests.conftest import SF001
from tests.oracle_compare import compare, duck


@pytest.fixture(scope="module")
def two_weeks(spark):
    root = tempfile.mkdtemp(prefix="tally-e2e-")
    delta = two_week_run(spark, SF001, root)
    return root, delta


def test_two_week_outputs(spark, two_weeks):
    root, delta = two_weeks
    st = Store(root)
    s1 = st.read(spark, "snapshots", WEEK1, SNAPSHOT)
    s2 = st.read(spark, "snapshots", WEEK2, SNAPSHOT)
    # new counters (users % 10 == 3) were named in week 1 and are carried on
    new1 = st.read(spark, "new_counters", WEEK1)
    assert new1.count() > 0
    assert new1.where(F.col("station").isNull()).count() == 0
    ids1 = {r.id for r in s1.select("id").collect()}
    ids2 = {r.id for r in s2.select("id").collect()}
    assert ids1 <= ids2
    assert s2.where(F.col("station").isNull()).count() == 0
    # The version read by week 2 is still there and unchanged
    w1 = st.read(spark, "weekly", WEEK1, WEEKLY)
    w2 = st.read(spark, "weekly", WEEK2, WEEKLY)
    assert w1.count() > 0 and w2.count() >= w1.count()
    assert delta.count() == w2.count()
    # a run's own counts are a written version too, merged into the accumulated table
    own = st.read(spark, "week_counts", WEEK2)
    assert 0 < own.count() <= w2.count()
    assert own.join(w2.select("linename", "station", "weekdate", "week"), ["linename", "station", "weekdate", "week"], "left_anti").isEmpty()
    assert {"d_weekend", "weekend_2022", "weekend_bl"} <= set(delta.columns)


def test_rerun_is_idempotent(spark, two_weeks):
    root, _ = two_weeks
    st = Store(root)
    before = sorted(map(str, st.read(spark, "weekly", WEEK2, WEEKLY).collect()))
    two_week_run(spark, SF001, root)
    after = sorted(map(str, st.read(spark, "weekly", WEEK2, WEEKLY).collect()))
    assert before == after


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["linename", "station", "weekdate", "weekend", "weekday_am", "weekday_pm", "week"]
    assert df.count() > 0


BANNED = ("BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for b in BANNED:
        assert b not in plan, f"{name}: {b}"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    r = compare(spark, SF001, name, E.queries()[name], ORACLE[name])
    assert r["ok"], r


def test_run_week_without_store_checkpoints(spark):
    from tally.config import RunConfig
    from tally.plans.week import run_week, weekly_from_readings
    from tally.sources import testbed as tb
    from tally.schemas import WEEKLY
    r, cfg = tb.readings_view_cfg(spark, SF001)
    names = tb.counter_names(r)
    acc = weekly_from_readings(None, r.where(F.col("datetime") < tb.ntz(tb.SPLIT)), names, cfg,
                               checked=True).select(*WEEKLY.fieldNames())
    base = acc.select("linename", "station", "week", "weekend", "weekday_am", "weekday_pm")
    res = run_week(spark, cfg.with_(run_date=WEEK1), tb.latest_readings(r), tb.prior_snapshot(r, cfg),
                   acc, tb.stations_lookup(spark, SF001), base)
    assert spark.sparkContext.getCheckpointDir()
    assert res.snapshot.count() == r.select("id").distinct().count()
    assert res.delta.count() == res.accumulated.count()


def test_single_shuffle_of_the_readings(spark):
    """Plain plan: D2-D4 shuffle the readings once (by id); D7 pre-aggregates before its join."""
    import re

    from tally.config import RunConfig
    from tally.operators import clean_deltas, raw_deltas, time_bucket, weekly_counts
    from tally.sources import testbed as tb

    root = tempfile.mkdtemp(prefix="tally-plan-")
    r = tb.readings_view(spark, SF001)
    r.write.parquet(f"{root}/readings")
    scan = spark.read.parquet(f"{root}/readings")
    plain = RunConfig(split_hot=False)
    clean = clean_deltas(raw_deltas(None, scan, plain), None, plain)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 1 and exchanges[0].startswith("id#"), exchanges
    weekly = weekly_counts(time_bucket(clean, plain), tb.counter_names(r), plain)
    plan = weekly._jdf.queryExecution().executedPlan().toString()
    # tree strings list parents before children: the per-counter aggregate sits below the first join
    join = re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join", plan).start()
    assert plan.index("HashAggregate(keys=[id#") > join


def test_rollup_shuffles_once_after_the_names_join(spark):
    """The executed rollup has one exchange on the station, line and week, none on the bucket."""
    import re

    from tally.config import RunConfig
    from tally.operators import time_bucket, weekly_counts
    from tally.sources import testbed as tb

    r = tb.readings_view(spark, SF001)
    deltas = r.select("id", "datetime", F.col("entries").alias("d_entries"))
    wide = weekly_counts(time_bucket(deltas, RunConfig()), tb.counter_names(r))
    wide.collect()
    plan = wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    rollup = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "weekdate#" in x and "station#" in x]
    assert len(rollup) == 1 and "time#" not in rollup[0], rollup


def test_queries_use_every_reading(spark):
    """Readings before the split seed the run, all later ones are its own."""
    from tally.sources import testbed as tb

    r = tb.readings_view(spark, SF001)
    at = tb.split_points(r)
    assert tb.latest_readings(r, at.start).count() == r.where(F.col("datetime") >= tb.ntz(at.start)).count()
    assert tb.latest_readings(r, at.start, at.end).count() + tb.latest_readings(r, at.end).count() == tb.latest_readings(r, at.start).count()
    assert at.start.weekday() == 5 and at.start.isoformat() == "2024-01-13T00:00:00"
    assert tb.split_points(r.limit(0)).start.weekday() == 5


def test_hot_counter_plan_partitions_by_chunk(spark):
    """Hot plan: the readings windows are partitioned by (id, time chunk), not by id alone."""
    import re

    from tally.config import RunConfig
    from tally.operators import clean_deltas, raw_deltas
    from tally.sources import testbed as tb

    r = tb.readings_view(spark, SF001)
    hot = RunConfig(hot_ranges=64)
    clean = clean_deltas(raw_deltas(None, r, hot), None, hot)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    # Window [expressions], [partition keys], [order].  Lags over the readings run per
    # (id, chunk); only the small per-chunk summaries (lag of __last) are windowed per id.
    windows = re.findall(r"Window \[(lag\([^\]]*)\], \[([^\]]*)\], \[", plan)
    readings = [keys for expr, keys in windows if not expr.startswith("lag(__last")]
    summaries = [keys for expr, keys in windows if expr.startswith("lag(__last")]
    assert readings and all("__chunk" in k for k in readings), readings
    assert summaries and all("__chunk" not in k for k in summaries), summaries
