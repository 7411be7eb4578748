"""Named queries over the supplied tables, one per operator group of the survey.

Each takes ``(spark, sf_dir)`` and returns a DataFrame; ``tally.plans.oracle``
holds an independent DuckDB SQL version of each for the correctness gate.
All read the whole tables; a query about one weekly run takes the earlier readings as what came before it
and all others as the run's (``testbed.split_points``).
"""

from __future__ import annotations

import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.functions.columns import drop_columns, lower_names, rename_columns
from tally.functions.exprs import (concat_strict, not_in_keep_null, parse_mdy_hms,
                                   saturday_floor, week_number, yymmdd)
from tally.operators.chunked import CHUNK
from tally.operators.compare import baseline_ratio
from tally.operators.counted import count_copies, counted_raw, counted_snapshot
from tally.operators.deltas import clean_deltas, dominant_direction, raw_deltas
from tally.operators.snapshot import latest_per_counter, next_snapshot, snapshot_join
from tally.operators.weekly import merge_weekly, time_bucket, weekly_counts
from tally.plans.week import weekly_from_readings
from tally.sources import testbed as tb
from tally.sources.readings import read_readings

CFG = RunConfig()


def _view(spark, sf_dir, cfg):
    """Readings view plus the run config with its hot-counter decision."""
    return tb.readings_view_cfg(spark, sf_dir, cfg)


def _scenario(spark, sf_dir, cfg):
    r, cfg = _view(spark, sf_dir, cfg)
    start = tb.split_points(r).start
    return r, tb.prior_snapshot(r, cfg, start), tb.latest_readings(r, start), cfg


def _raw_of(prior, latest, cfg):
    """D2 of the scenario, persisted: the queries below read it several times."""
    return raw_deltas(prior, latest, cfg).persist(StorageLevel.MEMORY_AND_DISK)


def _raw(spark, sf_dir, cfg):
    r, prior, latest, cfg = _scenario(spark, sf_dir, cfg)
    return _raw_of(prior, latest, cfg), cfg


def flagship_weekly_counts(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """D2 D3 D4 D6 A2 A3 over all readings: station x week x bucket."""
    r, cfg = _view(spark, sf_dir, cfg)
    return weekly_from_readings(None, r, tb.counter_names(r), cfg, checked=True)


def anti_set_filter(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Drop two event types; rows with a missing type are kept."""
    ev = tb.load(spark, sf_dir, "events")
    typ = F.when(F.col("event_id") % 11 != 0, F.col("event_type"))
    return (ev.select("event_id", typ.alias("event_type"))
            .where(not_in_keep_null("event_type", ["error", "signup"])))


def compose_id(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """``a_b_c`` id; a missing part makes the id missing."""
    o = tb.load(spark, sf_dir, "orders")
    prio = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", concat_strict("o_orderstatus", prio, F.col("o_custkey").cast("string"),
                                                sep="_").alias("id"))


def _mdy_text():
    d = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")) \
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    t = F.concat(F.lit(" "), (F.col("o_orderkey") % 24).cast("string"), F.lit(":"),
                 F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.lit(":"),
                 F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"))
    return F.when(F.col("o_orderkey") % 17 == 0, F.lit("garbage")).otherwise(F.concat(d, t))


def parse_timestamp(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """E5: month/day/year h:m:s text to timestamp; malformed text is null."""
    o = tb.load(spark, sf_dir, "orders").select("o_orderkey", _mdy_text().alias("s"))
    return o.select("o_orderkey", "s", parse_mdy_hms("s").alias("datetime"))


def parse_mixed_separators(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """E5 with dashes, dots and blanks between the parts as well as slashes and colons."""
    o = tb.load(spark, sf_dir, "orders").select("o_orderkey", _mdy_text().alias("s"))
    k = F.col("o_orderkey") % 5
    s = (F.when(k == 0, F.translate("s", "/", "-")).when(k == 1, F.translate("s", "/:", "..")).when(k == 2, F.translate("s", "/:", "  "))
         .when(k == 3, F.concat(F.lit(" "), F.translate("s", "/:", "-."), F.lit("  "))).otherwise(F.col("s")))
    o = o.select("o_orderkey", s.alias("s"))
    return o.select("o_orderkey", "s", parse_mdy_hms("s").alias("datetime"))


def raw_deltas_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Carried-over + new readings, first difference per counter."""
    return _raw(spark, sf_dir, cfg)[0].drop(CHUNK)


def dominant_direction_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Modal non-zero sign per counter, ties kept."""
    raw, cfg = _raw(spark, sf_dir, cfg)
    return dominant_direction(raw, cfg)


def clean_deltas_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Dominant-way readings, re-differenced, plausible only."""
    raw, cfg = _raw(spark, sf_dir, cfg)
    return clean_deltas(raw, None, cfg)


def latest_per_counter_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Each counter's latest rows, ties kept, null-poisoned groups dropped."""
    raw, cfg = _raw(spark, sf_dir, cfg)
    return latest_per_counter(raw, cfg)


def snapshot_full_join_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Latest rows full-joined with the prior snapshot's names."""
    r, prior, latest, cfg = _scenario(spark, sf_dir, cfg)
    raw = _raw_of(prior, latest, cfg)
    return snapshot_join(latest_per_counter(raw, cfg), prior)


def new_counter_enrichment(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """The next snapshot, new counters named from the lookup."""
    r, prior, latest, cfg = _scenario(spark, sf_dir, cfg)
    raw = _raw_of(prior, latest, cfg)
    snap, _ = next_snapshot(raw, prior, latest, tb.stations_lookup(spark, sf_dir), cfg)
    return snap


def time_bucket_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """peak/weekend filter, Monday week, bucket label."""
    ev = tb.load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("datetime"))
    return time_bucket(ev, cfg)


def weekly_pivot(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """This run's weekly counts through the next snapshot's names."""
    r, prior, latest, cfg = _scenario(spark, sf_dir, cfg)
    raw = _raw_of(prior, latest, cfg)
    snap, _ = next_snapshot(raw, prior, latest, tb.stations_lookup(spark, sf_dir), cfg)
    clean = clean_deltas(raw, None, cfg)
    return weekly_counts(time_bucket(clean, cfg), snap, cfg)


def week_number_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Non-ISO week number."""
    o = tb.load(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderdate", week_number("o_orderdate").alias("week"))


def merge_weekly_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Weekly counts of two halves of the readings, merged per cell."""
    r, cfg = _view(spark, sf_dir, cfg)
    names, cut = tb.counter_names(r), tb.split_points(r).cut
    old = weekly_from_readings(None, r.where(F.col("datetime") < tb.ntz(cut)), names, cfg, checked=True)
    new = weekly_from_readings(None, tb.latest_readings(r, cut), names, cfg, checked=True)
    return merge_weekly(new, old)


def _baseline(r, names, cfg):
    base_end = tb.split_points(r).base_end
    early = weekly_from_readings(None, r.where(F.col("datetime") < tb.ntz(base_end)), names, cfg,
                                 checked=True)
    st = F.col("station")
    return early.select(
        "linename", "station", "week",
        F.when(st.isin("NATION_1", "NATION_6"), F.lit(0.0)).otherwise(F.col("weekend")).alias("weekend"),
        F.when(~st.isin("NATION_2", "NATION_7"), F.col("weekday_am")).alias("weekday_am"),
        "weekday_pm", F.col("weekdate").alias("base_weekdate"))


def baseline_ratio_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Weekly counts over the baseline, canonical names."""
    r, cfg = _view(spark, sf_dir, cfg)
    names = tb.counter_names(r)
    weekly = weekly_from_readings(None, r, names, cfg, checked=True)
    return baseline_ratio(weekly, _baseline(r, names, cfg), tb.stations_lookup(spark, sf_dir), cfg)


def week_file_date(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """The Saturday file date, its yymmdd tag, the prior file date."""
    o = tb.load(spark, sf_dir, "orders")
    fd = saturday_floor("o_orderdate")
    return o.select("o_orderkey", fd.alias("file_date"), yymmdd(fd).alias("file_tag"),
                    F.date_sub(fd, 7).alias("prior_date"))


def multi_file_union(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Files with raw headers, landed one folder each, read as one table by one scan."""
    o = tb.load(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    part = F.when(st.isin("F", "O"), st).otherwise(F.lit("rest"))
    root = _scratch(spark, "files")
    (o.select(F.col("o_orderkey").alias("O_ORDERKEY"), F.col("o_orderpriority").alias("C/A"), F.col("o_totalprice").alias("O_TotalPrice"),
              F.col("o_orderstatus").alias("O_ORDERSTATUS"), part.alias("file")).write.partitionBy("file").parquet(root))
    files = [f"{root}/{x['file']}" for x in o.select(F.concat(F.lit("file="), part).alias("file")).distinct().orderBy("file").collect()]
    raw = spark.read.parquet(*files) if files else spark.read.schema("O_ORDERKEY long, `C/A` string, O_TotalPrice double, O_ORDERSTATUS string").parquet(root)
    u = rename_columns(lower_names(raw), {"c/a": "c_a"})
    return drop_columns(u.select("o_orderkey", "c_a", "o_totalprice", "o_orderstatus"), "o_orderstatus")


def new_counters_written(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """K1: the run's new counters, published through a store and read back."""
    from tally.sources.store import Store

    r, prior, latest, cfg = _scenario(spark, sf_dir, cfg)
    _, new = next_snapshot(_raw_of(prior, latest, cfg), prior, latest, tb.stations_lookup(spark, sf_dir), cfg)
    store, day = Store(_scratch(spark, "new")), tb.split_points(r).start.date()
    return store.publish(spark, latest.select("id", "datetime", "entries", "station", "linename").limit(0) if new is None else new, "new_counters", day)


def counted_snapshot_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """D2 D5 J2 on counted rows: every prior row twice is one row with two copies; the next snapshot has their products."""
    r, prior, latest, cfg = _scenario(spark, sf_dir, cfg)
    twice = count_copies(prior.unionByName(prior)).persist(StorageLevel.MEMORY_AND_DISK)
    raw = counted_raw(twice, latest, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    snap, _ = counted_snapshot(raw, twice, latest, tb.stations_lookup(spark, sf_dir), cfg)
    return snap.withColumn("copies", F.col("copies").cast("long"))


def second_week_snapshot(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """D5 twice: the second run takes all later readings from the first one's snapshot (C1's no-growth branch)."""
    r, cfg = _view(spark, sf_dir, cfg)
    at = tb.split_points(r)
    prior, latest = tb.prior_snapshot(r, cfg, at.start), tb.latest_readings(r, at.start, at.end)
    stations = tb.stations_lookup(spark, sf_dir)
    raw1 = _raw_of(prior, latest, cfg)
    snap1, _ = next_snapshot(raw1, prior, latest, stations, cfg)
    snap1 = snap1.persist(StorageLevel.MEMORY_AND_DISK)
    latest2 = tb.latest_readings(r, at.end)
    raw2 = raw_deltas(snap1, latest2, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    snap2, _ = next_snapshot(raw2, snap1, latest2, stations, cfg)
    return snap2


def all_weeks_run_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """Every week of the readings, landed and run in order through a store.

    Lookups are landed as CSV with shuffled and extra columns and read by
    their headers; the result is the last run's baseline comparison, of
    all weeks.  Files go to the session's checkpoint folder.
    """
    from tally.plans.e2e import all_weeks_run

    return all_weeks_run(spark, sf_dir, _scratch(spark, "weeks"), cfg)


def one_plan_run_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """D1-D9 of all weeks in one plan: one scan of all files, no run by run chain."""
    from tally.plans.e2e import one_plan_run

    return one_plan_run(spark, sf_dir, _scratch(spark, "history"), cfg)


def late_file_run_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """S1 S2 with a correction that lands after its week and the later ones have run: those weeks run again."""
    from tally.plans.e2e import late_file_run

    return late_file_run(spark, sf_dir, _scratch(spark, "late"), cfg)


def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder in the session's checkpoint folder (the cluster's shared scratch)."""
    from tally.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-{what}-{uuid.uuid4().hex}"


def snapshot_distinct_names(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """J2 with ``distinct_prior_names``: a counter's tied earlier rows don't multiply its new ones."""
    r, prior, latest, cfg = _scenario(spark, sf_dir, cfg)
    prior = prior.unionByName(prior)  # every counter tied
    raw = _raw_of(prior, latest, cfg)
    return snapshot_join(latest_per_counter(raw, cfg), prior, cfg.with_(distinct_prior_names=True))


def read_readings_q(spark: SparkSession, sf_dir: str, cfg: RunConfig = CFG) -> DataFrame:
    """D1 (S1 P1 P2 F1 P3 E1 E5): all readings landed as a readings file, read back and cleaned.

    The file is written by Spark into the session's checkpoint folder (the
    cluster's shared scratch), one folder per scale directory.
    """
    from tally.plans.e2e import land_week
    from tally.session import ensure_checkpoint_dir

    r, cfg = _view(spark, sf_dir, cfg)
    tag = re.sub(r"[^A-Za-z0-9.]+", "_", sf_dir.strip("/"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-landing/{tag}"
    land_week(r, path)
    return read_readings(spark, path, cfg)


# The same queries with every counter of more than 16 readings cut into ranges, as hot
# counters are: windows run per (counter, range) with seed rows, the vote and the latest
# reading use grouped aggregates and joins.  They must equal the plain plans exactly.
SPLIT_CFG = RunConfig(max_rows_per_key=16)


def _split(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(spark, sf_dir, SPLIT_CFG)
    run.__name__ = fn.__name__ + "_split"
    run.__doc__ = (fn.__doc__ or "") + " (hot-counter plan)"
    return run


QUERIES = {
    "flagship_weekly_counts": flagship_weekly_counts,
    "anti_set_filter": anti_set_filter,
    "compose_id": compose_id,
    "parse_timestamp": parse_timestamp,
    "raw_deltas": raw_deltas_q,
    "dominant_direction": dominant_direction_q,
    "clean_deltas": clean_deltas_q,
    "latest_per_counter": latest_per_counter_q,
    "snapshot_full_join": snapshot_full_join_q,
    "new_counter_enrichment": new_counter_enrichment,
    "time_bucket": time_bucket_q,
    "weekly_pivot": weekly_pivot,
    "week_number": week_number_q,
    "merge_weekly": merge_weekly_q,
    "baseline_ratio": baseline_ratio_q,
    "week_file_date": week_file_date,
    "multi_file_union": multi_file_union,
    "second_week_snapshot": second_week_snapshot,
    "read_readings": read_readings_q,
    "all_weeks_run": all_weeks_run_q,
    "late_file_run": late_file_run_q,
    "one_plan_run": one_plan_run_q,
    "parse_mixed_separators": parse_mixed_separators,
    "new_counters_written": new_counters_written,
    "counted_snapshot": counted_snapshot_q,
    "snapshot_distinct_names": snapshot_distinct_names,
    "raw_deltas_split": _split(raw_deltas_q),
    "clean_deltas_split": _split(clean_deltas_q),
    "latest_per_counter_split": _split(latest_per_counter_q),
    "flagship_weekly_counts_split": _split(flagship_weekly_counts),
}
