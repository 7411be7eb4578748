"""Two consecutive weekly runs over data derived from the supplied tables.

The readings view is landed as weekly files in the public readings format
(one folder per file date, written by Spark), then week 1 runs from the
derived prior snapshot and accumulated table, and week 2 runs from week 1's
published outputs.  This exercises every source, sink and operator.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.functions.exprs import concat_strict, saturday_floor
from tally.operators.compare import baseline_ratio
from tally.plans.backfill import backfill
from tally.plans.history import run_history
from tally.plans.week import WeekResult, run_week, weekly_from_readings
from tally.schemas import BASELINE, READINGS_RAW, SNAPSHOT, STATIONS, WEEKLY
from tally.session import size_shuffles, written
from tally.sources import testbed as tb
from tally.sources.readings import read_landed, read_readings
from tally.sources.store import Store, read_table

__all__ = ["land_week", "land_all_weeks", "counter_id", "two_week_run", "all_weeks_run", "late_file_run", "one_plan_run"]

WEEK1 = dt.date(2024, 1, 13)
WEEK2 = dt.date(2024, 1, 20)


def _parts(r: DataFrame):
    uid = F.col("id").cast("long")
    return {
        "c/a": F.concat(F.lit("A"), F.lpad(F.col("id"), 4, "0")),
        "unit": F.concat(F.lit("R"), F.lpad((uid % 25).cast("string"), 3, "0")),
        "scp": F.lit("00-00-00"),
    }


def counter_id(r: DataFrame) -> DataFrame:
    """Rename readings-view ids to the ``c/a_unit_scp`` ids the landed files produce."""
    p = _parts(r)
    return r.withColumn("id", concat_strict(p["c/a"], p["unit"], p["scp"], sep="_"))


def land_week(r: DataFrame, path: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> str:
    """Write readings with ``start <= datetime < end`` (no bounds: all, without a time too) as a readings file folder."""
    w = r
    if start is not None:
        w = w.where(F.col("datetime") >= tb.ntz(start))
    if end is not None:
        w = w.where(F.col("datetime") < tb.ntz(end))
    p = _parts(w)
    uid = F.col("id").cast("long")
    out = w.select(
        p["c/a"].alias("C/A"), p["unit"].alias("UNIT"), p["scp"].alias("SCP"),
        F.col("station").alias("STATION"), F.col("linename").alias("LINENAME"),
        F.when(uid % 50 == 49, F.lit("PTH")).otherwise(F.lit("BMT")).alias("DIVISION"),
        F.date_format("datetime", "MM/dd/yyyy").alias("DATE"),
        F.date_format("datetime", "HH:mm:ss").alias("TIME"),
        F.lit("REGULAR").alias("DESC"),
        F.format_string("%.0f", F.col("entries")).alias("ENTRIES"),
        F.lit("0").alias("EXITS"))
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def _land_csv(df: DataFrame, path: str, columns: list[str]) -> str:
    """A lookup as CSV with its columns in the given order, as a user might land it."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
    return path


@dataclass
class LandedWeeks:
    """A store that holds the state before the first file, the landed files by week, and the lookups."""

    store: Store
    readings: DataFrame          # with ids as the files have them, at whole seconds
    files: dict                  # {Saturday: path}
    stations: DataFrame
    baseline: DataFrame


def land_all_weeks(spark: SparkSession, sf_dir: str, root: str, cfg: RunConfig = RunConfig()) -> LandedWeeks:
    """Land every week after the first of the readings as files, and the lookups as CSV.

    The first week's readings give the state the chain starts from; the last
    file takes the readings without a time too, so none is left out.  Only
    the list of weeks, from the first and last reading, is on the driver.
    """
    store = Store(root)
    r0, hot = tb.readings_view_cfg(spark, sf_dir, cfg)
    r = _at_second(counter_id(r0))
    names = tb.counter_names(counter_id(tb.counter_names(r0)))  # ids made of counters, not of readings
    span = r0.agg(F.min(saturday_floor("datetime")).alias("a"), F.max(saturday_floor("datetime")).alias("b")).first()
    first, last = (span["a"], span["b"]) if span["a"] else (WEEK1, WEEK2)
    midnight = dt.datetime.combine(first, dt.time())
    week = dt.timedelta(days=7)

    before = _at_second(counter_id(r0.where(F.col("datetime") < tb.ntz(midnight + week))))
    early = written(weekly_from_readings(None, before, names, cfg))  # a lookup and the first state
    base = early.withColumn("base_weekdate", F.date_format("weekdate", "yyyy-MM-dd"))
    base = _land_csv(base, f"{root}/lookups/baseline.csv",
                     ["weekday_pm", "base_weekdate", "station", "week", "weekend", "linename", "weekday_am"])
    known = _land_csv(tb.stations_lookup(spark, sf_dir), f"{root}/lookups/stations.csv",
                      ["linename_new", "borough_id", "linename", "station_new", "station"])
    baseline, stations = read_table(spark, base, BASELINE, "csv"), read_table(spark, known, STATIONS, "csv")

    store.write(_at_second(counter_id(tb.prior_snapshot(r0, hot, midnight + week))), "snapshots", first)
    store.write(early.select(*WEEKLY.fieldNames()), "weekly", first)
    files, n = {}, max(1, (last - first).days // 7)
    for i in range(1, n + 1):
        a = midnight + i * week
        files[a.date()] = land_week(tb.latest_readings(r0, a, None if i == n else a + week), f"{root}/landing/{a:%y%m%d}")
    return LandedWeeks(store, r, files, stations, baseline)


def _last_comparison(spark: SparkSession, w: LandedWeeks, cfg: RunConfig) -> DataFrame:
    label = sorted(w.files)[-1]
    schema = baseline_ratio(w.store.read(spark, "weekly", label, WEEKLY), w.baseline, w.stations, cfg).schema
    return w.store.read_csv(spark, "baseline_delta", label, schema)


def all_weeks_run(spark: SparkSession, sf_dir: str, root: str, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Run every week after the first of the readings, oldest first; returns the last run's comparison."""
    w = land_all_weeks(spark, sf_dir, root, cfg)
    backfill(spark, w.store, w.files, w.stations, w.baseline, cfg)
    return _last_comparison(spark, w, cfg)


def one_plan_run(spark: SparkSession, sf_dir: str, root: str, cfg: RunConfig = RunConfig()) -> DataFrame:
    """The same landed files as ``all_weeks_run``, read by one scan and run in one plan; returns the last comparison."""
    w = land_all_weeks(spark, sf_dir, root, cfg)
    before = min(w.files) - dt.timedelta(days=7)
    size_shuffles(spark, list(w.files.values()))
    h = run_history(read_landed(spark, w.files, cfg), sorted(w.files), w.store.read(spark, "snapshots", before, SNAPSHOT),
                    w.store.read(spark, "weekly", before, WEEKLY), w.stations, cfg)
    return baseline_ratio(h.accumulated, w.baseline, w.stations, cfg)


def late_file_run(spark: SparkSession, sf_dir: str, root: str, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Every week, with half the readings of the middle one landing after all weeks have run.

    The second backfill is given the late file alone; it runs the middle week and
    those after it again.  Returns the last run's comparison, that of all readings.
    """
    w = land_all_weeks(spark, sf_dir, root, cfg)
    middle = sorted(w.files)[len(w.files) // 2]
    whole = spark.read.schema(READINGS_RAW).option("header", True).csv(w.files[middle])
    late = F.coalesce(F.crc32(F.concat_ws("|", *whole.columns).cast("binary")) % 2 == 0, F.lit(False))
    parts = {}
    for name, rows in (("first", whole.where(~late)), ("late", whole.where(late))):
        parts[name] = f"{root}/{name}/{middle:%y%m%d}"
        rows.write.option("header", True).csv(parts[name])
    backfill(spark, w.store, w.files | {middle: parts["first"]}, w.stations, w.baseline, cfg)
    backfill(spark, w.store, {middle: parts["late"]}, w.stations, w.baseline, cfg)
    return _last_comparison(spark, w, cfg)


def _at_second(df: DataFrame) -> DataFrame:
    # Landed files carry whole seconds; keep the derived state consistent.
    return df.withColumn("datetime", F.date_trunc("second", "datetime").cast("timestamp_ntz"))


def two_week_run(spark: SparkSession, sf_dir: str, root: str,
                 cfg: RunConfig = RunConfig()) -> DataFrame:
    """Run weeks 1 and 2; returns week 2's baseline comparison."""
    store = Store(root)
    r0, hot = tb.readings_view_cfg(spark, sf_dir, cfg)
    r = _at_second(counter_id(r0))
    stations = tb.stations_lookup(spark, sf_dir)
    names = tb.counter_names(r)
    baseline = weekly_from_readings(
        None, r.where(F.col("datetime") < tb.ntz(tb.BASE_END)), names, cfg
    ).select("linename", "station", "week", "weekend", "weekday_am", "weekday_pm")

    d1 = dt.datetime.combine(WEEK1, dt.time())
    d2 = dt.datetime.combine(WEEK2, dt.time())
    d3 = d2 + dt.timedelta(days=7)
    f1 = land_week(r0, f"{root}/landing/{WEEK1:%y%m%d}", d1, d2)
    f2 = land_week(r0, f"{root}/landing/{WEEK2:%y%m%d}", d2, d3)

    prior0 = _at_second(counter_id(tb.prior_snapshot(r0, hot)))
    acc0 = weekly_from_readings(None, r.where(F.col("datetime") < tb.ntz(d1)), names, cfg) \
        .select(*WEEKLY.fieldNames())
    store.write(prior0, "snapshots", WEEK1 - dt.timedelta(days=7))
    store.write(acc0, "weekly", WEEK1 - dt.timedelta(days=7))

    res: WeekResult | None = None
    for day, path in ((WEEK1, f1), (WEEK2, f2)):
        c = RunConfig(**{**cfg.__dict__, "run_date": day})
        prev = c.prior_date()
        res = run_week(spark, c, read_readings(spark, path, c),
                       store.read(spark, "snapshots", prev, SNAPSHOT),
                       store.read(spark, "weekly", prev, WEEKLY),
                       stations, baseline, store)
    return res.delta
