"""Weekly counts against the baseline year of the same week number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.config import BUCKETS, RunConfig
from tally.functions.columns import drop_suffix
from tally.functions.exprs import inf_to_null, ratio_r
from tally.operators.joins import join_nullsafe
from tally.schemas import BASELINE_KEYS, STATION_KEYS

__all__ = ["baseline_ratio"]


def baseline_ratio(weekly: DataFrame, baseline: DataFrame, stations: DataFrame,
                   cfg: RunConfig = RunConfig()) -> DataFrame:
    """Ratios to the baseline, then canonical names.

    Shared columns get ``_<label>`` / ``_bl`` suffixes.  x/0 is +Inf and then
    null, 0/0 is NaN and stays (T5).  Names become the lookup's ``_new`` names
    with no fallback unless ``cfg.fallback_names``; other lookup columns pass
    through and every ``*_new`` column is dropped.
    """
    lab = "_" + cfg.baseline_label
    base = baseline.withColumn("week", F.col("week").cast("int"))
    j = join_nullsafe(weekly, base,
                      BASELINE_KEYS, "left", suffixes=(lab, "_bl"))
    j = j.withColumns({f"d_{b}": ratio_r(f"{b}{lab}", f"{b}_bl") for b in BUCKETS})
    doubles = [f.name for f in j.schema.fields if isinstance(f.dataType, T.DoubleType)]
    j = j.withColumns({c: inf_to_null(c) for c in doubles})
    j = join_nullsafe(j, stations, STATION_KEYS, "left")
    if cfg.fallback_names:
        names = {"linename": F.coalesce("linename_new", "linename"),
                 "station": F.coalesce("station_new", "station")}
    else:
        names = {"linename": F.col("linename_new"), "station": F.col("station_new")}
    return drop_suffix(j.withColumns(names), "_new")
