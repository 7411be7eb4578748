"""Run parameters.  Defaults reproduce the reference's behaviour."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


# Fixed values of the reference's weekly job.
EXCLUDED_DIVISIONS = ("PTH", "RIT")          # divisions dropped at read
MIN_ROWS_FOR_DIRECTION = 5                   # rows an id needs to vote a direction
DELTA_CAP = 10000                            # per-interval counts must be below this
MAX_GAP_HOURS = 12                           # gap to the previous reading, whole hours
PEAK_HOURS = (8, 9, 10, 11, 18, 19, 20, 21)  # weekday hours kept for the rollup
WEEKEND_DAYS = (1, 7)                        # Spark dayofweek: Sunday 1, Saturday 7
BUCKETS = ("weekend", "weekday_am", "weekday_pm")
BASELINE_LABEL = "2022"                      # suffix of this year's columns in D9
# Date and time cells of the readings file, after a mark: month day year hour minute second.
MDY_HMS = r"^![^0-9A-Za-z]*(\d{1,2})[^0-9A-Za-z]+(\d{1,2})[^0-9A-Za-z]+(\d{4})[^0-9A-Za-z]+(\d{1,2})[^0-9A-Za-z]+(\d{1,2})[^0-9A-Za-z]+(\d{1,2}(?:\.\d{1,6})?)[^0-9A-Za-z]*$"
# The same cells as the public files write them, "MM/dd/yyyy HH:mm:ss".
USUAL_MDY_HMS = r"\A\d\d/\d\d/\d{4} \d\d:\d\d:\d\d\z"
FILE_TAG_FORMAT = "yyMMdd"                   # date label of a weekly file
MISSING_MARKERS = ("", "NA")                 # text cells read as missing


@dataclass(frozen=True)
class RunConfig:
    """Parameters of one weekly run.

    ``run_date`` replaces the reference's ``Sys.Date()`` so runs are
    reproducible; the file date is the latest Saturday on or before it.
    """

    run_date: dt.date | None = None
    excluded_divisions: tuple = EXCLUDED_DIVISIONS
    min_rows: int = MIN_ROWS_FOR_DIRECTION
    delta_cap: float = DELTA_CAP
    max_gap_hours: int = MAX_GAP_HOURS
    # "trunc" (default) or "floor" for the whole-hour gap of a negative interval.
    gap_rounding: str = "trunc"
    # The reference never counts a counter's first surviving interval of a run.
    keep_first_interval: bool = False
    # The reference joins every prior row of a counter, so tied rows multiply from run to
    # run.  True joins each distinct (id, station, linename) of the prior once instead.
    distinct_prior_names: bool = False
    # Equal snapshot rows are one row with a number of ``copies`` (a column of the
    # snapshot); sums and later copies are multiplied by it, as if the rows were there.
    counted_copies: bool = False
    # D9 replaces names by the lookup's names with no fallback (reference).
    fallback_names: bool = False
    baseline_label: str = BASELINE_LABEL
    # Break ties on (id, datetime) by the readings' place in their files, as the reference
    # does.  Otherwise the reading's value stands in, which needs no place.
    file_order: bool = False
    # A counter with more than ``max_rows_per_key`` rows is hot: its readings are
    # then cut by rank into ranges of about that many rows.  The run's check
    # (``split_hot``) sets ``hot_ranges`` to the number of such ranges in all readings, or
    # leaves it None (no hot counter: plain windows); a number given here is used as it is.
    split_hot: bool = True
    max_rows_per_key: int = 1_000_000
    hot_ranges: int | None = None
    # Also export the snapshot and the accumulated table as CSV, as the
    # reference writes them (missing as "NA" and as empty respectively).
    export_state_csv: bool = False
    peak_hours: tuple = PEAK_HOURS
    weekend_days: tuple = WEEKEND_DAYS

    def with_(self, **changes) -> "RunConfig":
        return replace(self, **changes)

    def file_date(self) -> dt.date:
        """Latest Saturday on or before ``run_date``."""
        d = self.run_date or dt.date.today()
        return d - dt.timedelta(days=(d.weekday() - 5) % 7)

    def prior_date(self) -> dt.date:
        """File date of the previous run."""
        return self.file_date() - dt.timedelta(days=7)
