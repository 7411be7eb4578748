"""Per-interval counts from cumulative readings.

All windows are keyed on the counter ``id`` and ordered by
``datetime`` (nulls last), then the tie-breakers of T1: ``src`` (carried-over
row first), ``entries`` (stands in for file order, which a distributed scan
cannot recover) and, after the direction join, ``sign``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.functions.exprs import gap_hours
from tally.operators.chunked import CHUNK, hot_ranges, hot_chunks, seeded_lag
from tally.operators.joins import join_nullsafe

__all__ = ["SRC_PRIOR", "SRC_NEW", "ORDER_RAW", "ORDER_CLEAN", "split_hot_counters",
           "raw_deltas", "dominant_direction", "attach_direction", "clean_deltas"]

SRC_PRIOR, SRC_NEW = 0, 1
ORDER_RAW = [("datetime", True), ("src", False), ("entries", True)]
ORDER_CLEAN = ORDER_RAW + [("sign", False)]
#: Place of a reading in its files, if the readings carry it: then it breaks ties before ``entries``.
PLACE = "place"


def ordered(df: DataFrame, order: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """``order`` with the file order (T1) where ``df`` has it; a carried-over row has no place and comes first by ``src``."""
    return [x for c, nl in order for x in ([(PLACE, True), (c, nl)] if c == "entries" and PLACE in df.columns else [(c, nl)])]


def split_hot_counters(readings: DataFrame, cfg: RunConfig) -> RunConfig:
    """Decide the plan: chunked windows only if some counter has more than ``max_rows_per_key`` rows.

    Without a hot counter a plain window per counter is cheapest
    (``hot_ranges`` None).  With one, ``hot_ranges`` says how many ranges all
    readings would make; only counters larger than a range are cut.  The check is one grouped count, combined map-side.
    """
    if not cfg.split_hot or cfg.hot_ranges:
        return cfg
    return cfg.with_(hot_ranges=hot_ranges(readings, ["id"], cfg.max_rows_per_key))


def raw_deltas(prior: DataFrame | None, latest: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Union the carried-over readings with the new ones and difference them.

    Output ``id, datetime, entries, src, d_entries``; the first row of each
    ``id`` has a null delta, a null reading makes two null deltas.  Readings with a
    ``place`` keep it, and tied ones are in file order.  With
    ``cfg.hot_ranges`` the readings of counters too large for one range in that many
    are cut by rank (``hot_chunks``), all others stay whole, and the output carries ``chunk`` too, which the later steps go by.
    """
    place = [PLACE] if PLACE in latest.columns else []
    parts = [latest.select("id", "datetime", "entries", F.lit(SRC_NEW).alias("src"), *place)]
    if prior is not None:
        parts.insert(0, prior.select("id", "datetime", "entries", F.lit(SRC_PRIOR).alias("src")))
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    order = ordered(u, ORDER_RAW)
    if cfg.hot_ranges:
        u = hot_chunks(u, ["id"], order, cfg.hot_ranges)
    d = seeded_lag(u, ["id"], order, ["entries"], F.col(CHUNK) if cfg.hot_ranges else None)
    return d.select("id", "datetime", "entries", "src",
                    (F.col("entries") - F.col("prev_entries")).alias("d_entries"), *place, *([CHUNK] if cfg.hot_ranges else []))


def dominant_direction(raw: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """D3: the most common non-zero sign of each counter's deltas, ties kept.

    Only counters with at least ``min_rows`` rows (every row counts, nulls and
    the carried-over row too) vote.  Output ``id, sign``; a +1/-1 tie gives two
    rows.  One grouped count per (id, sign) does all the heavy work, combined
    map-side, so a hot counter costs no more than any other.
    """
    sign = F.signum("d_entries")
    votes = raw.groupBy("id", sign.alias("sign")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id")
    votes = (votes.withColumn("rows", F.sum("n").over(w))
             .where((F.col("rows") >= cfg.min_rows) & (F.col("sign") != 0) & ~F.isnan("sign")))
    return (votes.withColumn("top", F.max("n").over(w))
            .where(F.col("n") == F.col("top")).select("id", "sign"))


def attach_direction(raw: DataFrame, cfg: RunConfig = RunConfig(),
                     direction: DataFrame | None = None) -> DataFrame:
    """Each reading once per dominant direction of its counter (``sign``).

    Readings of counters without a direction drop out, as the reference's
    left join followed by a null-rejecting filter does.  Without hot counters
    (``raw`` has no ``chunk``) the vote is a window over the counter, on
    the partitioning ``raw`` already has, and the tie fan-out is an
    ``explode``: no join and no shuffle.  With hot counters it is a join with
    the vote table on counter and chunk, so no task gets a whole hot counter.
    """
    hot = CHUNK in raw.columns
    if direction is None and not hot:
        w = Window.partitionBy("id")
        sign = F.signum("d_entries")
        counted = raw.withColumns({
            "__up": F.count(F.when(sign == 1, 1)).over(w),
            "__down": F.count(F.when(sign == -1, 1)).over(w),
            "__rows": F.count(F.lit(1)).over(w),
        })
        up, down = F.col("__up"), F.col("__down")
        votes = F.array(F.when((up > 0) & (up >= down), F.lit(1.0)),
                        F.when((down > 0) & (down >= up), F.lit(-1.0)))
        dirs = F.when(F.col("__rows") >= cfg.min_rows, F.filter(votes, lambda x: x.isNotNull()))
        return counted.select(*raw.columns, F.explode(dirs).alias("sign"))
    if direction is None:
        direction = dominant_direction(raw, cfg)
    if not hot:
        return join_nullsafe(raw, direction, ["id"], "inner")
    voted = join_nullsafe(raw.select("id", CHUNK).distinct(), direction, ["id"], "inner")
    return join_nullsafe(raw, voted, ["id", CHUNK], "inner")


def clean_deltas(raw: DataFrame, direction: DataFrame | None = None,
                 cfg: RunConfig = RunConfig()) -> DataFrame:
    """Keep readings moving the dominant way, re-difference, drop implausible ones.

    ``lag`` is recomputed over the survivors; the whole-hour gap and the cap
    filter close the step.  Output
    ``id, datetime, entries, src, sign, d_entries, d_time``.
    """
    j = attach_direction(raw, cfg, direction)
    moved = F.col("sign") * F.col("d_entries")
    keep = (moved >= 0) & ~F.isnan(moved)
    if cfg.keep_first_interval:
        keep = keep | (F.col("d_entries").isNull() & (F.col("src") == SRC_PRIOR))
    s = seeded_lag(j.where(keep), ["id"], ordered(j, ORDER_CLEAN), ["entries", "datetime"],
                   F.col(CHUNK) if CHUNK in raw.columns else None)
    d = s.select("id", "datetime", "entries", "src", "sign",
                 ((F.col("entries") - F.col("prev_entries")) * F.col("sign")).alias("d_entries"),
                 gap_hours("datetime", "prev_datetime", cfg.gap_rounding).alias("d_time"))
    return d.where((F.col("d_entries") < cfg.delta_cap) & (F.col("d_entries") >= 0)
                   & (F.col("d_time") >= -cfg.max_gap_hours))
