"""Engine inputs derived from the supplied tables (see FIXTURES.md section 2).

The supplied tables have no running totals, so a readings view is built from
``events``: one counter per user, whose reading is the running sum of the
user's event values in integer cents (negated for every seventh user, so some
counters run backwards), named after the user's nation and region.  All of
it is Spark work over the whole tables; nothing is generated on the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.operators.chunked import CHUNK, hot_chunks, seeded_running_sum
from tally.operators.deltas import split_hot_counters

__all__ = ["SPLIT", "BASE_END", "Split", "split_points", "load", "readings_view", "readings_view_cfg", "prior_snapshot",
           "latest_readings", "stations_lookup", "counter_names", "ntz"]

# Dates of the two-week end-to-end run (the catalog's queries derive theirs from the data).
SPLIT = dt.datetime(2024, 1, 13)        # Saturday file date of its first run
BASE_END = dt.datetime(2024, 1, 15)     # baseline = weekly counts before this
NEW_COUNTER_MOD = (10, 3)               # users with id % 10 == 3 are new this run


@dataclass(frozen=True)
class Split:
    """Where the readings are cut into earlier and new ones, taken from their time span."""

    start: dt.datetime     # the Saturday on or before the middle: readings from here on are new

    @property
    def end(self) -> dt.datetime:          # the first run's readings end, the second's begin
        return self.start + dt.timedelta(days=7)

    @property
    def cut(self) -> dt.datetime:          # mid-week cut for the old/new weekly merge
        return self.start + dt.timedelta(days=4, hours=12)

    @property
    def base_end(self) -> dt.datetime:     # baseline = weekly counts before this
        return self.start + dt.timedelta(days=2)


def split_points(r: DataFrame) -> Split:
    """The split of a readings view; every reading lies on one side or the other."""
    t = r.agg(F.min("datetime").alias("a"), F.max("datetime").alias("b")).first()
    middle = (t["a"] + (t["b"] - t["a"]) / 2 if t["a"] else dt.datetime(1970, 1, 3)).date()
    saturday = middle - dt.timedelta(days=(middle.weekday() - 5) % 7)
    return Split(dt.datetime.combine(saturday, dt.time()))


def ntz(t: dt.datetime):
    """A TIMESTAMP_NTZ literal (no time-zone conversion)."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings_view(spark: SparkSession, sf_dir: str, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Readings ``id, datetime, entries, station, linename`` from ``events``."""
    return readings_view_cfg(spark, sf_dir, cfg)[0]


def readings_view_cfg(spark: SparkSession, sf_dir: str,
                      cfg: RunConfig = RunConfig()) -> tuple[DataFrame, RunConfig]:
    """The readings view and ``cfg`` with the hot-counter decision made on it.

    One counter per user, so the per-user check that chooses the running-sum
    plan also decides for every subset of the view; no second check is needed.
    """
    ev = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), "user_id", "event_id", F.col("ts").alias("datetime"),
        F.round(F.col("value") * 100).cast("long").alias("cents"))
    nation = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("station"), "n_regionkey")
    region = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"),
                                                  F.col("r_name").alias("linename"))
    names = nation.join(region, "n_regionkey").drop("n_regionkey")
    cfg = split_hot_counters(ev, cfg)
    # Named first, as a readings file is: whatever join Spark picks, the partitioning
    # by counter comes after it and the deltas' windows can reuse it.
    ev = ev.join(names, (F.col("user_id") % 25) == F.col("n_nationkey"))
    order = [("datetime", True), ("event_id", True)]
    if cfg.hot_ranges:
        ev = hot_chunks(ev, ["id"], order, cfg.hot_ranges)
    r = seeded_running_sum(ev, ["id"], order, "cents", "total", F.col(CHUNK) if cfg.hot_ranges else None)
    sign = F.when(F.col("user_id") % 7 == 0, F.lit(-1)).otherwise(F.lit(1))
    # The view stands for a landed readings table: every query reads it many
    # times, so it is materialised once per session (same plan, same cache).
    view = r.select("id", "datetime",
                    (sign * F.col("total")).cast("double").alias("entries"),
                    "station", "linename").persist(StorageLevel.MEMORY_AND_DISK)
    return view, cfg


def prior_snapshot(r: DataFrame, cfg: RunConfig = RunConfig(), start: dt.datetime = SPLIT) -> DataFrame:
    """Last reading of each known counter before ``start`` (ties kept).

    Without hot counters (``cfg`` of ``readings_view_cfg``) a window over the counter, on
    the view's own partitioning: no shuffle.  With hot ones a join that spreads them.
    """
    mod, rem = NEW_COUNTER_MOD
    before = r.where((F.col("datetime") < ntz(start)) & (F.col("id").cast("long") % mod != rem))
    if not cfg.hot_ranges:
        last = before.withColumn("__top", F.max("datetime").over(Window.partitionBy("id")))
        return last.where(F.col("datetime") == F.col("__top")).select("id", "datetime", "entries", "station", "linename")
    top = before.groupBy("id").agg(F.max("datetime").alias("datetime"))
    return before.join(top, ["id", "datetime"]).select("id", "datetime", "entries", "station", "linename")


def latest_readings(r: DataFrame, start: dt.datetime = SPLIT, end: dt.datetime | None = None) -> DataFrame:
    """Readings with ``start <= datetime < end``; without an end all later ones and those without a time."""
    if end is None:
        return r.where((F.col("datetime") >= ntz(start)) | F.col("datetime").isNull())
    return r.where((F.col("datetime") >= ntz(start)) & (F.col("datetime") < ntz(end)))


def stations_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station lookup: raw names to canonical names, one nation in five missing."""
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    j = nation.join(region, nation.n_regionkey == region.r_regionkey).where(F.col("n_nationkey") % 5 != 4)
    return j.select(F.col("n_name").alias("station"), F.col("r_name").alias("linename"),
                    F.concat(F.col("n_name"), F.lit("_ST")).alias("station_new"),
                    F.lower("r_name").alias("linename_new"),
                    F.col("n_regionkey").alias("borough_id"))


def counter_names(r: DataFrame) -> DataFrame:
    """``id, station, linename`` of every counter in the readings."""
    return r.select("id", "station", "linename").distinct()
