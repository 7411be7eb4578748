"""Equi-joins where a missing key matches a missing key.

Every join of the reference treats NA keys as equal, so keys are compared
with ``<=>``.  Spark still plans these as hash / sort-merge joins on
``(coalesce(k), isnull(k))``, never as a nested loop.  Non-key columns present
on both sides get suffixes, as the reference's joins do.  No side is marked for
broadcast: Spark broadcasts one only if its bytes, measured at run time (AQE),
are below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["join_nullsafe", "held_frames", "hold", "release"]

# Frames persisted by the operators (the D5 join, the readings of a run);
# a run releases them once its outputs are written.
_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist ``df`` (memory, spilling to disk) until the next ``release()``."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append(df)
    return df


def held_frames() -> int:
    """How many frames are held now; ``release`` of this number leaves them alone."""
    return len(_HELD)


def release(since: int = 0) -> None:
    """Unpersist every frame held after the first ``since`` ones."""
    while len(_HELD) > since:
        _HELD.pop().unpersist()


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                  suffixes: tuple[str, str] = (".x", ".y")) -> DataFrame:
    """Join on ``keys`` with null-safe equality; output keeps one copy of each key.

    For ``full`` joins the key is the first non-null of both sides.  Shared
    non-key columns are renamed ``name + suffix`` on each side.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    if shared:
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    tmp = {k: f"__r_{i}_{k}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(tmp)
    lcols, rcols = left.columns, right.columns

    def lc(c):
        return F.col(f"__l.`{c}`")

    def rc(c):
        return F.col(f"__r.`{c}`")

    # Aliases keep the sides apart when both derive from the same frame.
    cond = reduce(lambda a, b: a & b, [lc(k).eqNullSafe(rc(tmp[k])) for k in keys])
    j = left.alias("__l").join(right.alias("__r"), cond, how)
    if how in ("left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        return j
    key_cols = []
    for k in keys:
        if how in ("full", "outer", "full_outer", "fullouter"):
            key_cols.append(F.coalesce(lc(k), rc(tmp[k])).alias(k))
        elif how in ("right", "right_outer", "rightouter"):
            key_cols.append(rc(tmp[k]).alias(k))
        else:
            key_cols.append(lc(k).alias(k))
    rest_left = [lc(c).alias(c) for c in lcols if c not in keys]
    rest_right = [rc(c).alias(c) for c in rcols if c not in tmp.values()]
    return j.select(*key_cols, *rest_left, *rest_right)
