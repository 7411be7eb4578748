"""Many weekly runs, oldest first.

Each week's snapshot is the next week's input, and the reference's state
rules (tie fan-out in the full join, the null-datetime poison, the
row-count growth branch) make week k depend on all of week k-1's output.
Weeks therefore run in date order, each one a fully distributed job; the
versions written to the store cut the lineage between weeks, so a lost
executor never recomputes earlier weeks and a failed backfill resumes from
the last published week.  Each run publishes the list of files it read, so files
that land late are noticed, however they come in.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tally.config import RunConfig
from tally.operators.counted import COPIES, expand
from tally.plans.week import WeekResult, run_week
from tally.schemas import SNAPSHOT, WEEKLY
from tally.session import size_shuffles
from tally.sources.manifest import changes, input_files
from tally.sources.readings import observed, read_readings
from tally.sources.store import Store

__all__ = ["LateFiles", "backfill", "by_week", "is_done", "run_landed_week", "stale"]


def by_week(files: list[tuple[dt.date, str]]) -> dict[dt.date, list[str]]:
    """``{Saturday: paths}``: a run reads every file dated in its week, corrections included."""
    out: dict[dt.date, list[str]] = {}
    for day, path in sorted(files):
        out.setdefault(RunConfig(run_date=day).file_date(), []).append(path)
    return out


OUTPUTS = ("snapshots", "weekly", "baseline_delta")


class LateFiles(RuntimeError):
    """Files landed for, or changed in, a week whose successor has run (or files that a new run needs are gone)."""


def is_done(spark: SparkSession, store: Store, week: dt.date, cfg: RunConfig = RunConfig()) -> bool:
    """True if every output of that week's run is there, the last one included."""
    tables = [*OUTPUTS, *(("snapshots_csv", "weekly_csv") if cfg.export_state_csv else ())]
    return all(store.exists(spark, t, week) for t in tables)


def _started_from(spark: SparkSession, store: Store, prior: dt.date) -> dict:
    return {t: store.version(spark, t, prior) for t in ("snapshots", "weekly")}


def prior_state(spark: SparkSession, store: Store, day: dt.date, cfg: RunConfig) -> DataFrame:
    """A published snapshot, counted or in single rows as the run wants it, whichever it was written as."""
    counted = COPIES in [f["name"] for f in (store.entry(spark, "snapshots", day) or {}).get("schema", {}).get("fields", [])]
    if not counted:
        return store.read(spark, "snapshots", day, SNAPSHOT)
    rows = store.read(spark, "snapshots", day)
    return rows if cfg.counted_copies else expand(rows)


def run_landed_week(spark: SparkSession, store: Store, run_date: dt.date, readings_path,
                    stations: DataFrame, baseline: DataFrame, cfg: RunConfig = RunConfig(),
                    latest: DataFrame | None = None) -> WeekResult:
    """One week from a landed readings file and the store's previous versions.

    The run's manifest is published last, as version ``file_date`` of ``runs``: the
    files it read, the versions it started from and, by column, how many cells
    held text that could not be parsed.
    """
    c = cfg.with_(run_date=run_date)
    prev = c.prior_date()
    files = input_files(spark, readings_path)  # before the read: a file that lands meanwhile is not in it
    started = _started_from(spark, store, prev)
    seen = None
    if latest is None:
        size_shuffles(spark, readings_path)
        latest, seen = observed(read_readings(spark, [f[0] for f in files] or readings_path, c, flags=True))
    result = run_week(spark, c, latest,
                      prior_state(spark, store, prev, cfg),
                      store.read(spark, "weekly", prev, WEEKLY),
                      stations, baseline, store)
    if seen is not None:
        result.unparsed = seen.get
    store.commit(spark, "runs", c.file_date(), {"version": "manifest", "files": files, "prior": started, "unparsed": result.unparsed})
    return result


def stale(spark: SparkSession, store: Store, week: dt.date, files: list[list], cfg: RunConfig = RunConfig()) -> dict | None:
    """Why a week must run (again); None if its run is up to date with ``files`` and its prior state."""
    run = store.entry(spark, "runs", week)
    if run is None or not is_done(spark, store, week, cfg):
        return {"never run": [week.isoformat()]}
    why = changes(run["files"], files)
    if run["prior"] != _started_from(spark, store, week - dt.timedelta(days=7)):
        why["prior state"] = [(week - dt.timedelta(days=7)).isoformat()]
    return why or None


def backfill(spark: SparkSession, store: Store, files: dict, stations: DataFrame,
             baseline: DataFrame, cfg: RunConfig = RunConfig(),
             resume: bool = True, late: str = "rerun") -> list[dt.date]:
    """Run ``{file_date: path or paths}`` week by week, oldest first; returns the Saturdays run.

    Files of one week, whatever their dates, are read by one run.  With
    ``resume``, weeks whose run is up to date are skipped, so a failed
    backfill restarts where it stopped.  A week that got a new or changed file
    after its run runs again, with the files it read before, and so does every
    later week, as each starts from the one before; ``late="refuse"`` raises
    ``LateFiles`` instead, naming week and files, unless it is the newest week.
    """
    if late not in ("rerun", "refuse"):
        raise ValueError(f"late must be 'rerun' or 'refuse', not {late!r}")
    flat = [(day, p) for day, ps in files.items() for p in ([ps] if isinstance(ps, str) else ps)]
    given = by_week(flat)
    ran = store.dates(spark, "runs")
    given |= {w: [] for w in ran if w not in given}  # weeks whose prior state was made anew must follow
    done = []
    for week, paths in sorted(given.items()):
        before = [f[0] for f in (store.entry(spark, "runs", week) or {"files": []})["files"]]
        now = input_files(spark, [*paths, *before])
        why = stale(spark, store, week, now, cfg)
        if resume and why is None:
            continue
        missing = (why or {}).get("gone")
        if missing:
            raise LateFiles(f"week {week} must run again, but files it read are gone: {', '.join(missing)}")
        named = {k: v for k, v in (why or {}).items() if k in ("new", "changed")}
        if late == "refuse" and named and any(w > week for w in ran):
            raise LateFiles(f"week {week} got files after a later week had run: {named}")
        run_landed_week(spark, store, week, [f[0] for f in now], stations, baseline, cfg)
        done.append(week)
    return done
