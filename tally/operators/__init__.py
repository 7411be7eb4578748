"""Composite operators D2-D9 and the helpers they are built from."""

from tally.operators.joins import hold, join_nullsafe, release
from tally.operators.chunked import hot_chunks, hot_ranges, rank_chunks, seeded_lag, seeded_running_sum
from tally.operators.deltas import (attach_direction, clean_deltas, dominant_direction, raw_deltas,
                                    split_hot_counters)
from tally.operators.snapshot import growing_copies, latest_per_counter, snapshot_join, next_snapshot
from tally.operators.weekly import time_bucket, weekly_counts, merge_weekly
from tally.operators.compare import baseline_ratio

__all__ = [
    "hold", "release", "join_nullsafe", "hot_chunks", "hot_ranges", "rank_chunks", "seeded_lag",
    "seeded_running_sum", "split_hot_counters", "attach_direction",
    "raw_deltas", "dominant_direction", "clean_deltas", "latest_per_counter",
    "snapshot_join", "growing_copies", "next_snapshot", "time_bucket", "weekly_counts",
    "merge_weekly", "baseline_ratio",
]
