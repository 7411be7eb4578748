"""D2-D7 on counted rows: equal rows are one row with a number of ``copies``.

The reference joins every prior row of a counter by every tied latest row (J2), so
equal rows multiply from run to run: 2, 4, 16, 256.  Here they stay one row and the
number multiplies.  Expanded (``expand``), every result equals the plain operators'.

What copies mean step by step: of a row's copies in a counter's order the first
differs from the row before, each further one from its twin: a zero difference at
no distance in time, whatever its direction.  Sums are multiplied by the copies
of the names they are joined with.  Copies are doubles: exact up to 2**53.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.config import BUCKETS, RunConfig
from tally.functions.exprs import gap_hours, week_number
from tally.operators.chunked import CHUNK, hot_chunks, seeded_lag
from tally.operators.deltas import ORDER_CLEAN, ORDER_RAW, SRC_NEW, SRC_PRIOR
from tally.operators.joins import hold, join_nullsafe

__all__ = ["COPIES", "count_copies", "expand", "counted_raw", "counted_clean", "counted_latest", "counted_join",
           "counted_snapshot", "counted_weekly"]

COPIES = "copies"


def count_copies(df: DataFrame) -> DataFrame:
    """Equal rows as one row with ``copies``; a table that has the column (null: one) is summed up."""
    rows = [c for c in df.columns if c != COPIES]
    n = F.sum(F.coalesce(F.col(COPIES), F.lit(1.0))) if COPIES in df.columns else F.count(F.lit(1)).cast("double")
    return df.groupBy(*rows).agg(n.alias(COPIES))


def expand(df: DataFrame) -> DataFrame:
    """Counted rows as single ones."""
    rows = [c for c in df.columns if c != COPIES]
    return df.select(*rows, F.explode(F.sequence(F.lit(1), F.col(COPIES).cast("long"))).alias("__i")).drop("__i")


def counted_raw(prior: DataFrame | None, latest: DataFrame, cfg: RunConfig = RunConfig(), keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """D2 of counted ``prior`` rows (``copies``) and single ``latest`` ones, per ``keys``; ``d_entries`` is the first copy's.

    With ``cfg.hot_ranges`` rows are dealt by rank as in ``raw_deltas``.
    """
    cols = [*keys, "datetime", "entries"]
    u = latest.select(*cols, F.lit(SRC_NEW).alias("src"), F.lit(1.0).alias(COPIES))
    if prior is not None:
        u = u.unionByName(prior.select(*cols, F.lit(SRC_PRIOR).alias("src"), F.col(COPIES).cast("double").alias(COPIES)))
    if cfg.hot_ranges:
        u = hot_chunks(u, list(keys), ORDER_RAW, cfg.hot_ranges)
    d = seeded_lag(u, list(keys), ORDER_RAW, ["entries"], F.col(CHUNK) if cfg.hot_ranges else None)
    return d.withColumn("d_entries", F.col("entries") - F.col("prev_entries")).drop("prev_entries")


def _voted(raw: DataFrame, cfg: RunConfig, keys: list[str]) -> DataFrame:
    """Each row once per dominant direction of its counter; all copies count as rows, only first ones vote."""
    sign = F.signum("d_entries")
    votes = {"__up": F.sum(F.when(sign == 1, 1).otherwise(0)), "__down": F.sum(F.when(sign == -1, 1).otherwise(0)), "__rows": F.sum(COPIES)}
    if CHUNK not in raw.columns:
        counted = raw.withColumns({c: v.over(Window.partitionBy(*keys)) for c, v in votes.items()})
    else:
        totals = raw.groupBy(*keys).agg(*[v.alias(c) for c, v in votes.items()])
        spread = join_nullsafe(raw.select(*keys, CHUNK).distinct(), totals, keys, "inner")
        counted = join_nullsafe(raw, spread, [*keys, CHUNK], "inner")
    up, down = F.col("__up"), F.col("__down")
    dirs = F.array(F.when((up > 0) & (up >= down), F.lit(1.0)), F.when((down > 0) & (down >= up), F.lit(-1.0)))
    dirs = F.when(F.col("__rows") >= cfg.min_rows, F.filter(dirs, lambda x: x.isNotNull()))
    return counted.select(*raw.columns, F.explode(dirs).alias("sign"))


def counted_clean(raw: DataFrame, cfg: RunConfig = RunConfig(), keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """D3 D4 of counted rows: ``(keys, datetime, entries, src, sign, d_entries, d_time, copies)``."""
    j = _voted(raw, cfg, list(keys))
    moved = F.col("sign") * F.col("d_entries")
    first = F.coalesce((moved >= 0) & ~F.isnan(moved), F.lit(False))
    if cfg.keep_first_interval:
        first = first | (F.col("d_entries").isNull() & (F.col("src") == SRC_PRIOR))
    number = F.col("entries").isNotNull() & ~F.isnan("entries")
    more = F.when(number, F.col(COPIES) - 1).otherwise(F.lit(0.0))  # twins: a difference of zero
    kept = j.withColumn(COPIES, first.cast("double") + more).where(F.col(COPIES) >= 1)
    s = seeded_lag(kept, list(keys), ORDER_CLEAN, ["entries", "datetime"], F.col(CHUNK) if CHUNK in raw.columns else None)
    delta = (F.col("entries") - F.col("prev_entries")) * F.col("sign")
    gap = gap_hours("datetime", "prev_datetime", cfg.gap_rounding)

    def row(d, t, n):
        return F.struct(d.cast("double").alias("d_entries"), t.cast("long").alias("d_time"), n.alias(COPIES))

    ok = (delta < cfg.delta_cap) & (delta >= 0) & (gap >= -cfg.max_gap_hours)
    twins = (F.col(COPIES) > 1) & F.col("datetime").isNotNull() & F.lit(cfg.delta_cap > 0 and cfg.max_gap_hours >= 0)
    rows = F.filter(F.array(F.when(ok, row(delta, gap, F.lit(1.0))), F.when(twins, row(F.lit(0.0) * F.col("sign"), F.lit(0), F.col(COPIES) - 1))), lambda x: x.isNotNull())
    return s.select(*keys, "datetime", "entries", "src", "sign", F.explode(rows).alias("r")).select(*keys, "datetime", "entries", "src", "sign", "r.*")


def counted_latest(raw: DataFrame) -> DataFrame:
    """O5/W6 of counted rows: ``(id, datetime, entries, copies)``; a counter with a null time has none."""
    top = (raw.groupBy("id").agg(F.max("datetime").alias("__max"), F.max(F.col("datetime").isNull()).alias("__any_null"))
           .where(~F.col("__any_null")).select("id", F.col("__max").alias("datetime")))
    timed = raw.where(F.col("datetime").isNotNull()).select("id", "datetime", "entries", COPIES)
    return count_copies(join_nullsafe(timed, top, ["id", "datetime"], "inner"))


def counted_join(latest_rows: DataFrame, prior: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """J2 of counted rows: latest rows by the prior's names, their copies multiplied."""
    names = count_copies(prior.select("id", "station", "linename", COPIES))
    if cfg.distinct_prior_names:
        names = names.withColumn(COPIES, F.lit(1.0))
    j = join_nullsafe(latest_rows, names, ["id"], "full", suffixes=("__l", "__n"))
    one = F.lit(1.0)
    return (j.withColumn(COPIES, F.coalesce(f"{COPIES}__l", one) * F.coalesce(f"{COPIES}__n", one))
            .select("id", "datetime", "entries", "station", "linename", COPIES))


def named(unnamed: DataFrame, latest: DataFrame, stations: DataFrame) -> DataFrame:
    """F4 J3 J4 E2 of counted rows: this run's raw names, canonical ones where known; a row once per name."""
    own = [c for c in unnamed.columns if c not in ("station", "linename")]
    keys = [c for c in ("id", "run") if c in own]
    names = latest.select(*keys, "station", "linename").distinct()
    j = join_nullsafe(unnamed.select(*own), names, keys, "left")
    j = join_nullsafe(j, stations.select("station", "linename", "station_new", "linename_new"), ["station", "linename"], "left")
    return j.select(*own, F.coalesce("station_new", "station").alias("station"), F.coalesce("linename_new", "linename").alias("linename"))


def counted_snapshot(raw: DataFrame, prior: DataFrame, latest: DataFrame, stations: DataFrame,
                     cfg: RunConfig = RunConfig()) -> tuple[DataFrame, DataFrame | None]:
    """D5 of counted rows: ``(snapshot, new_counters)``; branch C1 compares the expanded numbers of rows."""
    joined = hold(counted_join(counted_latest(raw), prior, cfg))
    n = joined.select(COPIES).unionByName(prior.select((-F.col(COPIES)).alias(COPIES))).agg(F.sum(COPIES).alias("d")).first()["d"]
    if (n or 0) > 0:
        new = count_copies(named(joined.where(F.col("station").isNull()), latest, stations).select(*joined.columns))
        return count_copies(joined.where(F.col("station").isNotNull()).unionByName(new)), new
    return count_copies(joined), None


def counted_weekly(bucketed: DataFrame, snapshot: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """D7 of counted rows: a counter's sums times the copies of each of its names (twins add nothing to a sum)."""
    extra = [k for k in keys if k != "id"]
    per_id = bucketed.groupBy(*keys, "weekdate").agg(*[F.sum(F.when(F.col("time") == b, F.col("d_entries"))).alias(b) for b in BUCKETS])
    names = count_copies(snapshot.select(*keys, "station", "linename", COPIES))
    j = join_nullsafe(per_id, names, list(keys), "left")
    wide = j.groupBy(*extra, "linename", "station", "weekdate").agg(*[F.sum(F.col(b) * F.coalesce(COPIES, F.lit(1.0))).alias(b) for b in BUCKETS])
    return wide.select(*extra, "linename", "station", "weekdate", *BUCKETS, week_number("weekdate").alias("week"))
