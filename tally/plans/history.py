"""All weeks in one plan: what ``backfill`` computes run by run, as one Spark job.

A run needs of the earlier ones only each counter's latest reading, its names and how
many copies of a row the snapshot joins have made by then.  So:

1. The readings of all files are parsed once and dealt by (counter, run).  On that partitioning
   each run's latest rows are found, and later all differences.
2. One small row a (counter, run) - its latest time, ties, a null time - is folded per
   counter over the runs: which run's latest rows the snapshot holds after each run,
   how often, and when a null time has lost the counter's state.  The fold is
   one built-in expression over an array with one entry a run the counter appears in.
3. The rows a run starts from are read off the fold and meet the readings on the
   same partitioning; D2-D4, D6 and D7 run per (counter, run).
4. The accumulated table takes each cell from the last run that has a value for it.

Names are fixed when a counter is first seen; that holds if none lacks a station name
then.  (Without one, its names depend on whether the whole snapshot grew, run by
run; such inputs are refused by name and go through ``backfill``.)
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.config import BUCKETS, RunConfig
from tally.operators.chunked import hot_ranges
from tally.operators.counted import COPIES, count_copies, counted_clean, counted_raw, counted_weekly, named
from tally.operators.joins import join_nullsafe
from tally.operators.weekly import time_bucket
from tally.schemas import WEEKLY_KEYS
from tally.session import written

__all__ = ["History", "run_history"]

_SOURCE = "array<struct<run:int,times:double>>"
_STEP = f"struct<run:int,here:boolean,untouched:boolean,lost:boolean,sources:{_SOURCE},before:double,after:double>"
_STATE = ("struct<run:int,known:boolean,untouched:boolean,lost:boolean,time:timestamp_ntz,total:double,tied:double,"
          f"sources:{_SOURCE},steps:array<{_STEP}>>")


@dataclass
class History:
    weekly: DataFrame        # every run's weekly counts: run, linename, station, weekdate, buckets, week
    accumulated: DataFrame   # the accumulated table after the last run
    snapshot: DataFrame      # counted rows after the last run


def _struct(kind: str, **fields: Column) -> Column:
    """A struct of a given type; fields in the type's order."""
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(kind)


def _squares(total: Column, runs: Column) -> Column:
    """What ``runs`` runs without a reading multiply the copies by: each joins all rows by all names."""
    return F.when((total == 1) | (runs <= 0), F.lit(1.0)).otherwise(F.pow(total, F.pow(F.lit(2.0), runs) - 1))


def _pass(s: Column, upto: Column) -> Column:
    """State ``s`` after the runs before ``upto``, none of which has a reading of the counter."""
    runs = upto - s["run"] - 1
    quiet = s["lost"] | ~s["known"] | (runs <= 0)
    # the first of these runs keeps the latest rows of an untouched first snapshot only
    once = F.when(s["untouched"], s["tied"]).otherwise(s["total"])
    total1 = once * s["total"]
    factor = s["total"] * _squares(total1, runs - 1)
    gap = F.transform(F.sequence(F.lit(1), F.greatest(runs, F.lit(1))), lambda j: _struct(
        _STEP, run=s["run"] + j, here=F.lit(False), untouched=s["untouched"] & (j == 1), lost=F.lit(False),
        sources=_times(s["sources"], F.when(j == 1, F.lit(1.0)).otherwise(s["total"] * _squares(total1, j - 2))),
        before=F.when(j == 1, s["total"]).otherwise(total1 * _squares(total1, j - 2)), after=total1 * _squares(total1, j - 1)))
    # a run without a reading makes a difference only if there are copies
    steps = F.when(~quiet & (s["total"] > 1), F.concat(s["steps"], gap)).otherwise(s["steps"])
    moved = ~quiet
    return _struct(_STATE, run=upto - 1, known=s["known"], untouched=s["untouched"] & (runs <= 0), lost=s["lost"], time=s["time"],
                   total=F.when(moved, total1 * _squares(total1, runs - 1)).otherwise(s["total"]), tied=s["tied"],
                   sources=F.when(moved, _times(s["sources"], factor)).otherwise(s["sources"]), steps=steps)


def _times(sources: Column, factor: Column) -> Column:
    return F.transform(sources, lambda x: F.struct(x["run"].alias("run"), (x["times"] * factor).alias("times"))).cast(_SOURCE)


def _step(s: Column, x: Column, names: Column) -> Column:
    """State after run ``x`` (run, top, any_null, ties), which has readings of the counter."""
    none = F.array().cast(_SOURCE)
    here = _struct(_STEP, run=x["run"], here=F.lit(True), untouched=s["untouched"], lost=s["lost"], sources=s["sources"], before=F.when(s["known"], s["total"]), after=F.lit(None))
    lost = s["known"] & (s["lost"] | x["any_null"])
    newer = ~s["known"] | (x["top"] > s["time"])
    same = s["known"] & (x["top"] == s["time"])
    # the latest rows: this run's, the held ones, or both
    held = F.when(s["untouched"], s["tied"]).otherwise(s["total"])
    rows = F.when(newer, x["ties"]).when(same, held + x["ties"]).otherwise(held)
    by = F.when(s["known"], s["total"]).otherwise(names)
    own = F.array(F.struct(x["run"].alias("run"), by.alias("times"))).cast(_SOURCE)
    sources = F.when(newer, own).when(same, F.concat(_times(s["sources"], by), own)).otherwise(_times(s["sources"], by))
    begins = ~s["known"] & x["any_null"]  # no state yet, and none from this run
    total = F.when(lost, s["total"]).otherwise(rows * by)

    def done(after: Column) -> Column:
        return F.concat(s["steps"], F.array(here.withField("after", after))).cast(f"array<{_STEP}>")

    return (F.when(begins, _struct(_STATE, run=x["run"], known=F.lit(False), untouched=F.lit(False), lost=F.lit(False), time=F.lit(None), total=F.lit(0.0),
                                   tied=F.lit(0.0), sources=none, steps=done(F.lit(None).cast("double"))))
            .otherwise(_struct(_STATE, run=x["run"], known=F.lit(True), untouched=F.lit(False), lost=lost, time=F.when(newer, x["top"]).otherwise(s["time"]),
                               total=total, tied=F.lit(0.0), sources=F.when(lost, none).otherwise(sources), steps=done(total))))


def _fold(per_run: DataFrame, known: DataFrame, names: DataFrame, last: int) -> DataFrame:
    """``(id, steps, end)``: the runs that matter of each counter, and its state after the last one."""
    runs = per_run.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("run", "top", "any_null", "ties"))).alias("runs"))
    weight = names.groupBy("id").agg(F.sum(COPIES).alias("names"))
    j = join_nullsafe(join_nullsafe(runs, known, ["id"], "full"), weight, ["id"], "left")
    there = F.col("total0").isNotNull()
    lost = there & F.coalesce("any_null0", F.lit(False))
    none = F.array().cast(_SOURCE)
    start = _struct(_STATE, run=F.lit(0), known=there, untouched=there, lost=lost, time=F.col("top0"), total=F.coalesce("total0", F.lit(0.0)), tied=F.coalesce("tied0", F.lit(0.0)),
                    sources=F.when(there & ~lost, F.array(F.struct(F.lit(0).alias("run"), F.lit(1.0).alias("times"))).cast(_SOURCE)).otherwise(none),
                    steps=F.array().cast(f"array<{_STEP}>"))
    weigh = F.coalesce("names", F.lit(1.0))
    end = F.aggregate(F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)), start,
                      lambda s, x: F.get(F.transform(F.array(_pass(s, x["run"])), lambda p: _step(p, x, weigh)), 0))
    j = j.withColumn("end0", end).withColumn("end", _pass(F.col("end0"), F.lit(last + 1)))
    return j.select("id", F.col("end.steps").alias("steps"), "end", "names")


def run_history(readings: DataFrame, runs: list[dt.date], prior: DataFrame, accumulated: DataFrame, stations: DataFrame,
                cfg: RunConfig = RunConfig()) -> History:
    """Every run of ``runs`` (Saturdays, oldest first) over ``readings`` in one plan.

    ``readings``: ``id, datetime, station, linename, entries`` and ``run``, the run's
    date.  ``prior``: the snapshot before the first run (``copies`` or single rows).
    Equal to ``backfill`` over the same files; the snapshot is counted.  An empty
    table of readings passes the state on.  The list of runs is all the driver holds.
    """
    runs = sorted(runs)
    spark, last = readings.sparkSession, len(runs)
    number = F.create_map(*[x for i, d in enumerate(runs) for x in (F.lit(d), F.lit(i + 1))]) if runs else F.lit(None)
    numbered = readings.select("id", (F.element_at(number, F.col("run")) if runs else F.lit(None)).cast("int").alias("run"), "datetime", "station", "linename", "entries")
    numbered = written(numbered)  # several jobs follow; the files are read and parsed once
    if cfg.split_hot and not cfg.hot_ranges:
        cfg = cfg.with_(hot_ranges=hot_ranges(numbered, ["id", "run"], cfg.max_rows_per_key))
    if cfg.hot_ranges:  # a counter too large for a task: its latest rows are found by joins that spread it
        rows = numbered
        tops = numbered.groupBy("id", "run").agg(F.max("datetime").alias("top"), F.max(F.col("datetime").isNull()).alias("any_null"))
        at_end = join_nullsafe(numbered.where(F.col("datetime").isNotNull()), tops.where(~F.col("any_null")).select("id", "run", F.col("top").alias("datetime")), ["id", "run", "datetime"])
        ends = written(at_end.groupBy("id", "run", "datetime", "entries").agg(F.count(F.lit(1)).cast("double").alias(COPIES)))
        ties = ends.groupBy("id", "run").agg(F.sum(COPIES).alias("ties"))
        per_run = written(join_nullsafe(tops, ties, ["id", "run"], "left"))
    else:  # dealt once; each use below is on this partitioning
        rows = numbered.repartition("id", "run")
        per = Window.partitionBy("id", "run")
        marked = rows.withColumns({"top": F.max("datetime").over(per), "any_null": F.max(F.col("datetime").isNull()).over(per)})
        per_run = written(marked.groupBy("id", "run").agg(F.max("top").alias("top"), F.max("any_null").alias("any_null"),
                                                          F.sum(F.when(F.col("datetime") == F.col("top"), 1.0)).alias("ties")))
        ends = marked.where(~F.col("any_null") & (F.col("datetime") == F.col("top"))).groupBy("id", "run", "datetime", "entries").agg(F.count(F.lit(1)).cast("double").alias(COPIES))

    prior = count_copies(prior.select("id", "datetime", "entries", "station", "linename", *([COPIES] if COPIES in prior.columns else [])))
    tops = prior.groupBy("id").agg(F.max("datetime").alias("top0"), F.max(F.col("datetime").isNull()).alias("any_null0"), F.sum(COPIES).alias("total0"))
    first = join_nullsafe(prior, tops.select("id", "top0"), ["id"], "inner")
    tied = first.where("datetime = top0").groupBy("id").agg(F.sum(COPIES).alias("tied0"))
    known = join_nullsafe(tops, tied, ["id"], "left")
    # names: of the prior snapshot, or of the first run that gives a counter a state
    new = join_nullsafe(per_run.where(~F.col("any_null")).groupBy("id").agg(F.min("run").alias("run")), known.select("id", "total0"), ["id"], "left").where("total0 IS NULL")
    raw_names = join_nullsafe(rows.select("id", "run", "station", "linename").distinct(), new.select("id", "run"), ["id", "run"], "inner")
    own = named(new.select("id", "run", F.lit(1.0).alias(COPIES)), raw_names, stations).select("id", "station", "linename", COPIES)
    names = written(count_copies(own.unionByName(prior.select("id", "station", "linename", COPIES))))
    nameless = names.where(F.col("station").isNull()).select("id").first()
    if nameless is not None:
        raise ValueError(f"counter {nameless['id']} has no station name when first seen: run these weeks with backfill")

    folded = written(_fold(per_run, known, names, last))
    steps = folded.select("id", "names", F.explode("steps").alias("s")).select("id", "names", "s.*")
    steps = steps.where(F.col("here") | (F.col("before") > 1))
    # what each run starts from
    at_top = prior.withColumn("run", F.lit(0)).join(tops.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")) & (F.col("datetime") == F.col("top0")))
    at_top = at_top.groupBy("id", "run", "datetime", "entries").agg(F.sum(COPIES).alias(COPIES))
    held = steps.where(~F.col("untouched") & ~F.col("lost")).select("id", F.col("run").alias("into"), F.explode("sources").alias("s")).select("id", "into", "s.*")
    carried = join_nullsafe(held, ends.unionByName(at_top), ["id", "run"], "inner").select("id", F.col("into").alias("run"), "datetime", "entries", (F.col("times") * F.col(COPIES)).alias(COPIES))
    whole = join_nullsafe(steps.where("untouched").select("id", "run"), prior.select("id", "datetime", "entries", COPIES), ["id"], "inner")
    gone = steps.where(F.col("lost") & ~F.col("untouched")).select("id", "run", F.lit(None).cast("timestamp_ntz").alias("datetime"), F.lit(None).cast("double").alias("entries"), F.col("before").alias(COPIES))
    starts = carried.unionByName(whole).unionByName(gone).groupBy("id", "run", "datetime", "entries").agg(F.sum(COPIES).alias(COPIES)).repartition("id", "run")

    keys = ("id", "run")
    clean = counted_clean(counted_raw(starts, rows, cfg, keys), cfg, keys)
    # A run's counts go to each name as often as its snapshot has it
    factor = steps.where(F.col("after").isNotNull()).select("id", "run", (F.col("after") / F.col("names")).alias("times"))
    shown = join_nullsafe(factor, names, ["id"], "inner").select("id", "run", "station", "linename", (F.col("times") * F.col(COPIES)).alias(COPIES))
    weekly = counted_weekly(time_bucket(clean, cfg), shown, keys)

    cells = weekly.select("run", *WEEKLY_KEYS, *BUCKETS).unionByName(accumulated.select(F.lit(0).alias("run"), *WEEKLY_KEYS, *BUCKETS))
    merged = cells.groupBy(*WEEKLY_KEYS).agg(*[F.max_by(b, F.when(F.col(b).isNotNull(), F.col("run"))).alias(b) for b in BUCKETS])
    # after the last run: the held rows by the counter's names
    end = folded.where("end.known").select("id", "names", "end.*")
    each = end.where(~F.col("lost") & ~F.col("untouched")).select("id", "names", F.explode("sources").alias("s")).select("id", "names", "s.*")
    rows_left = join_nullsafe(each, ends.unionByName(at_top), ["id", "run"], "inner").select("id", "datetime", "entries", (F.col("times") * F.col(COPIES) / F.col("names")).alias("n"))
    blank = end.where("lost").select("id", F.lit(None).cast("timestamp_ntz").alias("datetime"), F.lit(None).cast("double").alias("entries"), (F.col("total") / F.col("names")).alias("n"))
    snapshot = join_nullsafe(rows_left.unionByName(blank), names, ["id"], "inner").select("id", "datetime", "entries", "station", "linename", (F.col("n") * F.col(COPIES)).alias(COPIES))
    if not runs:
        return History(weekly, accumulated.select(*WEEKLY_KEYS, *BUCKETS), prior)
    dates = F.element_at(F.array(*[F.lit(d) for d in runs]), F.col("run"))
    return History(weekly.withColumn("run", dates), merged, count_copies(snapshot))
