"""One weekly run: readings and last week's state in, this week's state out.

Paths 1-3 of the reference: readings -> snapshot (+ new counters),
readings -> weekly counts -> merged accumulated table, and the baseline
comparison export.  Every output is a new version in the store; the run
reads only earlier versions (T7).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tally.config import RunConfig
from tally.operators.compare import baseline_ratio
from tally.operators.counted import count_copies, counted_clean, counted_raw, counted_snapshot, counted_weekly
from tally.operators.deltas import clean_deltas, raw_deltas, split_hot_counters
from tally.operators.joins import held_frames, hold, release
from tally.operators.snapshot import growing_copies, next_snapshot
from tally.operators.weekly import merge_weekly, time_bucket, weekly_counts
from tally.schemas import WEEKLY
from tally.session import ensure_checkpoint_dir
from tally.sources.store import Store

__all__ = ["WeekResult", "weekly_from_readings", "run_week"]


@dataclass
class WeekResult:
    snapshot: DataFrame
    new_counters: DataFrame | None
    weekly: DataFrame          # this run's weekly counts
    accumulated: DataFrame     # merged accumulated table
    delta: DataFrame           # baseline comparison
    growing: DataFrame         # counters whose snapshot rows multiply (J2)
    unparsed: dict | None = None  # cells of the landed files that could not be parsed, by column (E5, T8)


def weekly_from_readings(prior: DataFrame | None, latest: DataFrame, names: DataFrame,
                         cfg: RunConfig = RunConfig(), checked: bool = False) -> DataFrame:
    """D2 -> D3 -> D4 -> D6 -> D7 with ``names`` (``id, station, linename``) for J5.

    Without hot counters all steps up to the rollup share ``raw``'s
    partitioning by counter, so the readings are shuffled once.  ``checked``
    says ``cfg`` already carries the hot-counter decision for these readings.
    """
    if not checked:
        cfg = split_hot_counters(latest, cfg)
    raw = raw_deltas(prior, latest, cfg)
    if cfg.hot_ranges:
        raw = hold(raw)  # hot counters: the vote table and the chunk seeds each re-read raw
    clean = clean_deltas(raw, None, cfg)
    return weekly_counts(time_bucket(clean, cfg), names, cfg)


def merge_touched_weeks(spark: SparkSession, store: Store, weekly: DataFrame, accumulated: DataFrame, cfg: RunConfig) -> DataFrame:
    """J6/D8 on the weeks that the run has cells for; returns the whole published table.

    The prior version's parts of other weeks are neither read nor written: the new
    version names them.  A store without a prior version takes all of ``accumulated``.
    The driver sees the run's week dates only.
    """
    day = cfg.file_date()
    prior = store.entry(spark, "weekly", cfg.prior_date())
    if prior is None or "parts" not in prior:
        return store.publish(spark, merge_weekly(weekly, accumulated), "weekly", day)
    touched = [r["part"] for r in weekly.select(store.part_of("weekly").alias("part")).distinct().collect()]
    old = store.read(spark, "weekly", cfg.prior_date(), WEEKLY, parts=touched)
    return store.publish(spark, merge_weekly(weekly, old), "weekly", day, onto=prior["parts"])


def run_week(spark: SparkSession, cfg: RunConfig, latest: DataFrame, prior: DataFrame,
             accumulated: DataFrame, stations: DataFrame, baseline: DataFrame,
             store: Store | None = None) -> WeekResult:
    """Run one week.  ``latest`` is D1's output for this run's file.

    With a ``store``, the snapshot, new counters, weekly counts, merged table and
    baseline export are written as version ``cfg.file_date()``, later steps read the
    written snapshot back (K5), and everything the run persisted is released
    at the end.  The accumulated table is then the store's version of the week
    before, of which only the touched weeks are read and written; ``accumulated``
    counts if there is none.  ``raw`` has three consumers and is persisted.
    """
    held = held_frames()
    try:
        return _run_week(spark, cfg, latest, prior, accumulated, stations, baseline, store)
    finally:
        if store is not None:  # everything is written; without a store the lazy results may use the frames
            release(held)


def _run_week(spark, cfg, latest, prior, accumulated, stations, baseline, store) -> WeekResult:
    day = cfg.file_date()
    latest = hold(latest)
    cfg = split_hot_counters(latest, cfg)
    if cfg.counted_copies:
        prior = hold(count_copies(prior))
        raw = hold(counted_raw(prior, latest, cfg))
        snapshot, new_counters = counted_snapshot(raw, prior, latest, stations, cfg)
    else:
        raw = hold(raw_deltas(prior, latest, cfg))
        snapshot, new_counters = next_snapshot(raw, prior, latest, stations, cfg)
    if store is not None:
        if new_counters is not None:
            new_counters = store.publish(spark, new_counters, "new_counters", day)
        else:
            store.drop(spark, "new_counters", day)
        snapshot = store.publish(spark, snapshot, "snapshots", day)
        if cfg.export_state_csv:
            store.export_csv(snapshot, "snapshots_csv", day, null_value="NA")
    else:
        # no store: cut the lineage in the cluster's checkpoint folder instead
        ensure_checkpoint_dir(spark)
        snapshot = snapshot.checkpoint(eager=True)

    if cfg.counted_copies:
        weekly = counted_weekly(time_bucket(counted_clean(raw, cfg), cfg), snapshot)
    else:
        weekly = weekly_counts(time_bucket(clean_deltas(raw, None, cfg), cfg), snapshot, cfg)
    if store is not None:
        weekly = store.publish(spark, weekly, "week_counts", day)  # the result doesn't recompute the run
    if store is not None:
        merged = merge_touched_weeks(spark, store, weekly, accumulated, cfg)
        if cfg.export_state_csv:
            store.export_csv(merged, "weekly_csv", day)
    else:
        merged = merge_weekly(weekly, accumulated)
    delta = baseline_ratio(merged, baseline, stations, cfg)
    if store is not None:
        store.export_csv(delta, "baseline_delta", day)
        delta = store.read_csv(spark, "baseline_delta", day, delta.schema)
    return WeekResult(snapshot, new_counters, weekly, merged, delta, growing_copies(snapshot, prior))
