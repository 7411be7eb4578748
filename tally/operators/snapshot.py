"""The next snapshot of every counter's last reading, and new counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.operators.chunked import CHUNK
from tally.operators.joins import hold, join_nullsafe

__all__ = ["latest_per_counter", "snapshot_join", "growing_copies", "enrich_new_counters", "next_snapshot"]


def latest_per_counter(raw: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Rows at their counter's latest ``datetime``, ties kept.

    A counter with any null ``datetime`` has a null maximum in the reference
    and drops out entirely (T4).  The maximum is a grouped aggregate (combined
    map-side), joined back on ``(id, datetime)``, which spreads a hot counter
    over many tasks.  Without hot counters (``raw`` has no ``chunk``) it is a
    window over the counter on ``raw``'s own partitioning instead.
    Output ``id, datetime, entries, d_entries``.
    """
    cols = ["id", "datetime", "entries", "d_entries"]
    if CHUNK not in raw.columns:
        w = Window.partitionBy("id")
        return (raw.select(*cols, F.max("datetime").over(w).alias("__max"),
                           F.max(F.col("datetime").isNull()).over(w).alias("__any_null"))
                .where(~F.col("__any_null") & (F.col("datetime") == F.col("__max")))
                .select(*cols))
    top = (raw.groupBy("id")
           .agg(F.max("datetime").alias("__max"),
                F.max(F.col("datetime").isNull()).alias("__any_null"))
           .where(~F.col("__any_null"))
           .select("id", F.col("__max").alias("datetime")))
    timed = raw.where(F.col("datetime").isNotNull())  # the others never match
    return join_nullsafe(timed.select(*cols), top, ["id", "datetime"], "inner")


def snapshot_join(latest_rows: DataFrame, prior: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Attach known names; counters on either side are kept.

    With ``cfg.distinct_prior_names`` each name of a counter joins once, however
    many tied rows the prior snapshot has of it.
    Output ``id, datetime, entries, d_entries, station, linename``.
    """
    names = prior.select("id", "station", "linename")
    return join_nullsafe(latest_rows, names.distinct() if cfg.distinct_prior_names else names, ["id"], "full")


def growing_copies(snapshot: DataFrame, prior: DataFrame) -> DataFrame:
    """``id, copies_before, copies`` of counters with several snapshot rows, more than in the prior one.

    Nothing is cut: the report lets the user choose ``distinct_prior_names``.
    """
    def total(df):  # rows may be counted
        return F.sum("copies") if "copies" in df.columns else F.count(F.lit(1))

    before = prior.groupBy("id").agg(total(prior).alias("copies_before"))
    now = snapshot.groupBy("id").agg(total(snapshot).alias("copies")).where("copies > 1")
    both = join_nullsafe(now, before, ["id"], "left")
    return (both.select("id", F.coalesce("copies_before", F.lit(0)).alias("copies_before"), "copies")
            .where("copies > copies_before"))


def enrich_new_counters(unnamed: DataFrame, latest: DataFrame, stations: DataFrame,
                        cfg: RunConfig = RunConfig()) -> DataFrame:
    """Raw names from this run's file, canonical names where known."""
    names = latest.select("id", "station", "linename").distinct()
    s = stations.select("station", "linename", "station_new", "linename_new")
    j = join_nullsafe(unnamed.select("id", "datetime", "entries"), names, ["id"], "left")
    j = join_nullsafe(j, s, ["station", "linename"], "left")
    return j.select("id", "datetime", "entries",
                    F.coalesce("station_new", "station").alias("station"),
                    F.coalesce("linename_new", "linename").alias("linename"))


def _grew(joined: DataFrame, prior: DataFrame) -> bool:
    """``nrow(joined) > nrow(prior)``, both counts in one job."""
    side = joined.select(F.lit(1).alias("__side")).unionByName(prior.select(F.lit(-1).alias("__side")))
    return (side.agg(F.sum("__side").alias("d")).first()["d"] or 0) > 0


def next_snapshot(raw: DataFrame, prior: DataFrame, latest: DataFrame, stations: DataFrame,
                  cfg: RunConfig = RunConfig()) -> tuple[DataFrame, DataFrame | None]:
    """Returns ``(snapshot, new_counters)``; ``new_counters`` is None when not grown.

    Branch C1 compares two row counts on the driver (scalars only), taken in
    one job.  The joined table is persisted so the branch does not recompute it, and so are the new counters.
    """
    joined = hold(snapshot_join(latest_per_counter(raw, cfg), prior, cfg))
    if _grew(joined, prior):
        old = joined.where(F.col("station").isNotNull()).drop("d_entries")
        new = hold(enrich_new_counters(joined.where(F.col("station").isNull()), latest, stations, cfg))  # a table and part of the snapshot
        return old.unionByName(new), new
    return joined.drop("d_entries"), None
