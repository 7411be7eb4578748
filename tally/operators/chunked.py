"""Order-dependent window functions that stay parallel under a hot key.

A plain ``lag`` over ``partitionBy(id)`` puts every reading of one counter
in one task; if one counter holds a third of the rows, so does that task.
Here the rows are cut into chunks along the order and the window runs per
``(key, chunk)``.  The value a chunk's first row needs from before the chunk
comes from a small per-chunk summary (partial aggregation, so the hot key is
combined map-side), shifted one chunk along a window over the summary, and
unioned into the chunk as a "seed" row that sorts first.  This is the same
device the reference uses between runs: the last reading of the previous run
seeds the lag of the next.

The result equals the plain window exactly.  Only the seed rows and the
summary, one row per (key, chunk), are extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.joins import join_nullsafe
from tally.session import written

__all__ = ["CHUNK", "hot_ranges", "hot_chunks", "rank_chunks", "split_bounds", "seeded_lag", "seeded_running_sum", "sort_exprs", "order_key"]

#: Name of the column that ``rank_chunks`` and ``hot_chunks`` add.
CHUNK = "chunk"
#: Rows sampled for a range of a hot key, and up to how many ranges the bounds are broadcast (about 3 MB).
SAMPLES, MAX_RANGES = 64, 50_000
#: Rows of a task that deals rows by rank.
PART_ROWS = 250_000

_CHUNK = "__chunk"
_SEED = "__seed"


def sort_exprs(order: list[tuple[str, bool]]) -> list[Column]:
    """Ascending sort expressions; each item is ``(column, nulls_last)``."""
    return [F.col(c).asc_nulls_last() if nl else F.col(c).asc_nulls_first() for c, nl in order]


def order_key(order: list[tuple[str, bool]]) -> Column:
    """A struct that compares like ``sort_exprs(order)`` (for ``max_by``)."""
    fields = []
    for i, (c, nl) in enumerate(order):
        if nl:
            fields.append(F.col(c).isNull().alias(f"n{i}"))
        fields.append(F.col(c).alias(f"v{i}"))
    return F.struct(*fields)


def hot_ranges(df: DataFrame, keys: list[str], max_rows: int) -> int | None:
    """Into how many ranges of about ``max_rows`` rows to cut ``df``; None if no key has more than that.

    One grouped count, combined map-side.  A quarter more than needed, as the
    bounds of the ranges come from a sample.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    got = per_key.agg(F.max("n").alias("top"), F.sum("n").alias("rows")).first()
    if got["top"] is None or got["top"] <= max_rows:
        return None
    return -(-5 * got["rows"] // (4 * max(max_rows, 1)))


def rank_chunks(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], ranges: int) -> DataFrame:
    """``df`` with a column ``CHUNK``: which range of (keys, order) a row lies in, of about four fifths of ``ranges`` equal ones.

    Rows are dealt by rank, so bursts and rows without a time are split like
    any others, and a key spans as many chunks as its rows need; only rows equal
    in the keys and the whole order stay together.  Tasks hold up to about ``PART_ROWS``
    rows, however small the ranges are: within a task a row's place in the sorted
    rows gives its range.  The rows are written to the checkpoint folder first, as counting,
    sampling and dealing each read them, and so is the result: all uses see the same bounds.
    """
    df = written(df)
    total = df.count()
    limit = max(1, 5 * total // (4 * max(ranges, 1)))  # rows of a range
    parts = max(1, min(ranges, -(-total // PART_ROWS)))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *sort_exprs(order)]
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    tied = Window.partitionBy(*keys, *[c for c, _ in order])
    first = F.min("__at").over(tied)  # the place of the first of equal rows
    return written(dealt.withColumn(CHUNK, F.floor(first / F.lit(limit))).drop("__at"))


def _per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def split_bounds(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], per_key: DataFrame, limit: int) -> DataFrame:
    """``(keys, __groups)`` of every key with more than ``limit`` rows: the bounds of its ranges, in groups.

    The sketch of a key's order is a sample of its rows by hash, ``SAMPLES`` a range:
    samples of parts merge by union, and the same rows give the same bounds in
    whatever parts they come.
    """
    hot = per_key.where(F.col("__n") > limit)  # fewer than all rows / limit keys
    share = min(1.0, SAMPLES / limit)
    picked = F.pmod(F.xxhash64(F.lit(1), *[F.col(c) for c in [*keys, *[c for c, _ in order]]]), F.lit(1 << 32)) < int(share * (1 << 32))
    rows = join_nullsafe(df.where(picked).select(*keys, order_key(order).alias("__k")), F.broadcast(hot), keys, "inner")
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__k")).alias("__s"), F.max("__n").alias("__n"))
    ranges = F.ceil(5 * F.col("__n") / (4 * limit)).cast("int")
    got = got.withColumn("__r", F.least(ranges, F.size("__s"))).where("__r > 1")
    bounds = F.transform(F.sequence(F.lit(1), F.col("__r") - 1), lambda i: F.get("__s", F.floor(i * F.size("__s") / F.col("__r")).cast("int")))
    got = got.select(*keys, F.array_distinct(bounds).alias("__b"))
    # groups of about the root of their number: a row compares with the groups' heads, then in one group
    step = F.ceil(F.sqrt(F.size("__b"))).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("__b") - 1) / step).cast("int")), lambda g: F.slice("__b", g * step + 1, step))
    return got.select(*keys, groups.alias("__groups"), step.alias("__step"))


def hot_chunks(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], ranges: int) -> DataFrame:
    """``df`` with a column ``CHUNK`` that cuts only the hot keys' rows into ranges of their order.

    A key is hot if it has more rows than a range of ``rank_chunks`` would hold; all
    rows of the others are chunk 0 and stay on whatever partitioning by key comes
    next: nothing is dealt by range or written but the bounds, which are
    small and broadcast.  Above ``MAX_RANGES`` all rows are dealt by rank instead.
    """
    if ranges > MAX_RANGES:
        return rank_chunks(df, keys, order, ranges)
    per_key = written(_per_key(df, keys))
    total = per_key.agg(F.sum("__n").alias("n")).first()["n"] or 0
    limit = max(1, 5 * total // (4 * ranges))
    bounds = written(split_bounds(df, keys, order, per_key, limit))  # every use sees the same bounds
    j = join_nullsafe(df.withColumn("__k", order_key(order)), F.broadcast(bounds), keys, "left")
    k, groups = F.col("__k"), F.col("__groups")
    head = F.size(F.filter(groups, lambda g: F.get(g, 0) <= k))
    inside = F.size(F.filter(F.get(groups, head - 1), lambda b: b <= k))
    chunk = F.when(groups.isNull() | (head == 0), F.lit(0)).otherwise((head - 1) * F.col("__step") + inside)
    return j.select(*df.columns, chunk.alias(CHUNK))


def seeded_lag(df: DataFrame, keys: list[str], order: list[tuple[str, bool]],
               values: list[str], chunk: Column | None, prefix: str = "prev_") -> DataFrame:
    """Add ``prefix + v`` = ``lag(v)`` over ``partitionBy(keys).orderBy(order)``.

    ``chunk`` must not decrease along the order of a key (e.g. the column of
    ``rank_chunks``); ``None`` runs the plain window.  Ties in ``order`` are broken arbitrarily, as in any window, so
    ``values`` should be part of the order or equal among tied rows.
    """
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*sort_exprs(order))
        return df.withColumns({prefix + v: F.lag(v).over(w) for v in values})
    work = df.withColumns({_CHUNK: chunk, _SEED: F.lit(1)})
    last = (work.groupBy(*keys, _CHUNK)
            .agg(F.max_by(F.struct(*values), order_key(order)).alias("__last")))
    wk = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).asc_nulls_last())
    seeds = (last.select(*keys, _CHUNK, F.lag("__last").over(wk).alias("__prev"))
             .where(F.col("__prev").isNotNull())
             .select(*keys, _CHUNK, F.lit(0).alias(_SEED),
                     *[F.col("__prev")[v].alias(v) for v in values]))
    both = work.unionByName(seeds, allowMissingColumns=True)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(F.col(_SEED), *sort_exprs(order))
    return (both.withColumns({prefix + v: F.lag(v).over(w) for v in values})
            .where(F.col(_SEED) == 1).drop(_CHUNK, _SEED))


def seeded_running_sum(df: DataFrame, keys: list[str], order: list[tuple[str, bool]],
                       value: str, out: str, chunk: Column | None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` over ``partitionBy(keys).orderBy(order)``.

    Rows-based frame: ``order`` should be total within a key.  With a
    ``chunk``, each chunk is seeded with the sum of all earlier chunks.
    """
    frame = (Window.unboundedPreceding, Window.currentRow)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*sort_exprs(order)).rowsBetween(*frame)
        return df.withColumn(out, F.sum(value).over(w))
    work = df.withColumns({_CHUNK: chunk, _SEED: F.lit(1)})
    tot = work.groupBy(*keys, _CHUNK).agg(F.sum(value).alias("__tot"))
    wk = (Window.partitionBy(*keys).orderBy(F.col(_CHUNK).asc_nulls_last())
          .rowsBetween(Window.unboundedPreceding, -1))
    seeds = (tot.select(*keys, _CHUNK, F.sum("__tot").over(wk).alias(value), F.lit(0).alias(_SEED))
             .where(F.col(value).isNotNull()))
    both = work.unionByName(seeds, allowMissingColumns=True)
    w = (Window.partitionBy(*keys, _CHUNK).orderBy(F.col(_SEED), *sort_exprs(order))
         .rowsBetween(*frame))
    return both.withColumn(out, F.sum(value).over(w)).where(F.col(_SEED) == 1).drop(_CHUNK, _SEED)
