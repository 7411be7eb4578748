"""Command line: the weekly job as a script, like the reference.

    python -m tally run      --store ROOT --readings PATH --stations PATH --baseline PATH [--run-date D] [--csv]
    python -m tally backfill --store ROOT --landing DIR   --stations PATH --baseline PATH
    python -m tally stream   --store ROOT --landing DIR   --stations PATH --baseline PATH --checkpoint DIR

``--run-date`` defaults to today; the file date is the latest Saturday on or
before it.  Lookup and baseline files are CSV (explicit schemas) or Parquet,
by extension.  Landed readings files carry their date as ``..._yymmdd.txt``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

from tally.config import RunConfig
from tally.schemas import BASELINE, STATIONS
from tally.session import get_session
from tally.sources.store import Store, read_table


def _lookup(spark, path, schema):
    fmt = "csv" if path.lower().endswith((".csv", ".txt")) else "parquet"
    return read_table(spark, path, schema if fmt == "csv" else None, fmt)


def _landed(spark, landing: str) -> dict:
    """``{Saturday: paths}`` of the readings files in a landing folder (listed on the driver)."""
    from tally.plans.backfill import by_week
    from tally.streaming.landing import landed_files

    return by_week(landed_files(spark, landing))


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="python -m tally")
    ap.add_argument("command", choices=["run", "backfill", "stream"])
    ap.add_argument("--store", required=True)
    ap.add_argument("--stations", required=True)
    ap.add_argument("--baseline", required=True)
    ap.add_argument("--readings")
    ap.add_argument("--landing")
    ap.add_argument("--checkpoint")
    ap.add_argument("--run-date", type=dt.date.fromisoformat)
    ap.add_argument("--master")
    ap.add_argument("--baseline-label", default="2022")
    ap.add_argument("--csv", action="store_true", help="also export snapshot and accumulated table as CSV")
    ap.add_argument("--file-order", action="store_true", help="break ties of readings by their place in the files")
    ap.add_argument("--counted", action="store_true", help="keep equal snapshot rows as one row with a number of copies")
    ap.add_argument("--late", choices=["rerun", "refuse"], help="what a file for a week that has run does (backfill: rerun, stream: refuse)")
    a = ap.parse_args(argv)

    spark = get_session(a.master)
    cfg = RunConfig(run_date=a.run_date, baseline_label=a.baseline_label, export_state_csv=a.csv,
                    file_order=a.file_order, counted_copies=a.counted)
    store = Store(a.store)
    stations = _lookup(spark, a.stations, STATIONS)
    baseline = _lookup(spark, a.baseline, BASELINE)
    if a.command == "run":
        from tally.plans.backfill import run_landed_week
        if not a.readings:
            ap.error("run needs --readings")
        run_landed_week(spark, store, cfg.file_date(), a.readings, stations, baseline, cfg)
        print(store.path("baseline_delta", cfg.file_date()))
    elif a.command == "backfill":
        from tally.plans.backfill import backfill
        if not a.landing:
            ap.error("backfill needs --landing")
        done = backfill(spark, store, _landed(spark, a.landing), stations, baseline, cfg, late=a.late or "rerun")
        print(" ".join(d.isoformat() for d in done))
    else:
        from tally.streaming import start_weekly_stream
        if not (a.landing and a.checkpoint):
            ap.error("stream needs --landing and --checkpoint")
        start_weekly_stream(spark, a.landing, store, a.checkpoint, stations, baseline, cfg, late=a.late or "refuse").awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
