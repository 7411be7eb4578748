"""tally: a Spark-native engine for cumulative-counter telemetry.

Readings are running totals published per counter.  The package turns them
into per-interval counts, votes each counter's direction, drops resets and
implausible jumps, carries each counter's last reading into the next run,
rolls counts up by station, week and time bucket, merges the result into an
accumulated table, and compares it with a baseline year.

Everything is DataFrame -> DataFrame over built-in expressions; see
``tally.plans.week.run_week`` for one run and ``tally.plans.backfill`` for
many runs in one job.
"""

from tally.config import RunConfig
from tally.session import get_session

__all__ = ["RunConfig", "get_session"]
