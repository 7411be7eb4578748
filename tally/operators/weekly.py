"""Time buckets, weekly station rollup, merge into the accumulated table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.config import BUCKETS, RunConfig
from tally.functions.exprs import day_bucket, in_set, monday_floor, week_number
from tally.operators.joins import join_nullsafe
from tally.schemas import WEEKLY_KEYS

__all__ = ["time_bucket", "weekly_counts", "merge_weekly"]


def time_bucket(deltas: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Keep weekday peak hours or any weekend hour; add ``weekdate`` and ``time``.

    The bucket comes from the reading's own timestamp (interval end).
    """
    ts = F.col("datetime")
    keep = in_set(F.hour(ts), cfg.peak_hours) | in_set(F.dayofweek(ts), cfg.weekend_days)
    return deltas.where(keep).withColumns({
        "weekdate": monday_floor(ts),
        "time": day_bucket(ts, cfg.weekend_days),
    })


def weekly_counts(bucketed: DataFrame, snapshot: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Sum of deltas by station, line, Monday week and bucket, pivoted wide.

    Deltas are first summed per ``(id, weekdate)``, one conditional sum a bucket, so
    the join with the snapshot's names and the one shuffle of the rollup carry one
    row per counter and week, not one per reading; both join sides are then per
    counter, so a plain shuffle join (or AQE's run-time broadcast) suits.  Sums distribute over the join,
    including its fan-out on duplicate snapshot rows, so the result equals
    joining first.  The three bucket columns always exist (T10).
    """
    per_id = bucketed.groupBy("id", "weekdate").agg(
        *[F.sum(F.when(F.col("time") == b, F.col("d_entries"))).alias(b) for b in BUCKETS])
    j = join_nullsafe(per_id, snapshot.select("id", "station", "linename"), ["id"], "left")
    wide = j.groupBy("linename", "station", "weekdate").agg(*[F.sum(b).alias(b) for b in BUCKETS])
    return wide.select("linename", "station", "weekdate", *BUCKETS,
                       week_number("weekdate").alias("week"))


def merge_weekly(new: DataFrame, old: DataFrame) -> DataFrame:
    """Full join on the four keys; per column the new value wins if not null."""
    j = join_nullsafe(new.select(*WEEKLY_KEYS, *BUCKETS), old.select(*WEEKLY_KEYS, *BUCKETS),
                      WEEKLY_KEYS, "full", suffixes=("__new", "__old"))
    return j.select(*WEEKLY_KEYS, *[F.coalesce(f"{b}__new", f"{b}__old").alias(b) for b in BUCKETS])
