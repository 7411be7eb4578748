"""Periodic runs of words, found as maximal pairs of a text's suffixes.

A run is a stretch of words with smallest period q that no neighbouring word
extends.  A maximal pair (two equal stretches that neither a word to the left
nor one to the right makes longer) of places i < j and length l covers the
words i .. j + l with period j - i; with l >= j - i it is a whole run, so
nothing has to be extended.

Within each text: the suffixes are sorted by doubling ranks and neighbours'
common prefixes read off the ranks.  The intervals of the LCP tree are visited
bottom-up, each with the sorted list of its places and their left-word class.
When a child joins an interval, only places that become neighbours in the list
can make a run of smallest period (a place between two others at distance of at
most their match would divide the period), and only if their left words differ.
Lists are joined small into large.  Intervals of a single left-word class, of
places further apart than the longest match, or below half the least length are
never visited: they hold no run.

All texts of a batch are sorted together, each only against itself.  Words are
named by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import _BASE, Words, bind, mix64, read, slices, suffix_ranks

SPACE = "[\\x20\\x09-\\x0D]+"
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places t of the order where suffixes t - 1 and t share at least ``least`` words, and how many."""
    low = levels[min(least.bit_length() - 1, len(levels) - 1)][order]
    t = np.flatnonzero(low[1:] == low[:-1]) + 1
    a, b = order[t - 1].astype(np.int64), order[t].astype(np.int64)
    size = np.zeros(len(t), dtype=np.int64)
    stop = len(end) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + size, b + size
        same = (x < end[a]) & (y < end[b])
        same &= levels[k][np.minimum(x, stop)] == levels[k][np.minimum(y, stop)]
        size[same] += 1 << k
    ok = size >= least
    return t[ok], size[ok]


def _pairs(large: list[int], small: list[int], match: int, left, least: int, out: list) -> None:
    """Maximal pairs of places that are neighbours once ``small`` joins ``large``."""
    last = len(small) - 1
    for k, y in enumerate(small):
        at = bisect_left(large, y)
        if at and (not k or large[at - 1] > small[k - 1]):
            p = y - large[at - 1]
            if p <= match and p + match >= least and left[y] != left[large[at - 1]]:
                out.append((large[at - 1], p + match, p))
        if at < len(large) and (k == last or large[at] < small[k + 1]):
            p = large[at] - y
            if p <= match and p + match >= least and left[y] != left[large[at]]:
                out.append((y, p + match, p))


def _join(x: tuple[list[int], int | None], y: tuple[list[int], int | None], match: int, left, least: int, out: list):
    """An interval of the LCP tree and a child: (sorted places, their one left class or None)."""
    (a, ca), (b, cb) = x, y
    if len(a) < len(b):
        a, b = b, a
    same = ca == cb and ca is not None
    if not same:
        _pairs(a, b, match, left, least, out)
    if b[0] > a[-1]:
        a.extend(b)
    elif len(b) * 16 < len(a):
        for p in b:
            insort(a, p)
    else:
        a.extend(b)
        a.sort()  # two sorted lists: merged in one pass
    return a, ca if same else None


def _tree(places: list[int], common: list[int], left, least: int, out: list) -> None:
    """Bottom-up visit of the LCP intervals of suffixes ``places``; ``common[t]`` is shared by t and t + 1."""
    stack: list[tuple[int, tuple]] = []
    for t, p in enumerate(places):
        node = ([p], left[p])
        depth = common[t] if t < len(common) else -1
        while stack and stack[-1][0] > depth:
            match, held = stack.pop()
            node = _join(held, node, match, left, least, out)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, _join(stack[-1][1], node, depth, left, least, out))
        elif depth >= 0:
            stack.append((depth, node))


def word_runs(words: Words, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a batch of texts, by start then period; starts number the batch's words."""
    n = len(words.hash)
    none = np.zeros(0, dtype=np.int64)
    if n < min_length:
        return none, none, none
    count = np.diff(words.first)
    end = np.repeat(words.first[1:], count).astype(np.int64)
    text = np.repeat(np.arange(1, len(count) + 1, dtype=np.uint64), count)
    order, levels = suffix_ranks(mix64(words.hash ^ (text * _BASE)), end)
    least = max(1, -(-min_length // 2))  # a run's pair matches at least half of it
    t, common = _common_prefixes(order, levels, end, least)
    if not len(t):
        return none, none, none
    left = np.full(n, -1, dtype=np.int32)  # class of the word to the left; a text's first word has none
    left[1:] = levels[0][:-1]
    left[words.first[:-1][count > 0]] = -1
    # stretches of the order that share ``least`` words: the subtrees that can hold runs
    cut = np.ones(len(t), dtype=bool)
    cut[1:] = t[1:] != t[:-1] + 1
    head = np.flatnonzero(cut)
    size = np.diff(np.append(head, len(t))) + 1  # places in each
    which = np.repeat(np.arange(len(head)), size)
    place = order[np.repeat(t[head] - 1 - (np.cumsum(size) - size), size) + np.arange(len(which))].astype(np.int64)
    first = np.cumsum(size) - size
    classes = left[place]
    mixed = np.maximum.reduceat(classes, first) != np.minimum.reduceat(classes, first)
    by_place = place[np.lexsort((place, which))]
    gap = np.full(len(place), n, dtype=np.int64)
    gap[1:] = by_place[1:] - by_place[:-1]
    gap[first] = n
    near = np.minimum.reduceat(gap, first) <= np.maximum.reduceat(common, head)
    some = mixed & near
    two = np.flatnonzero(some & (size == 2))
    a, b = place[first[two]], place[first[two] + 1]
    p, match = np.abs(a - b), common[head[two]]
    ok = (p <= match) & (p + match >= min_length)
    out: list[tuple[int, int, int]] = []
    more = np.flatnonzero(some & (size > 2))
    lefts = memoryview(left)
    for s in more.tolist():
        k, h, f = int(size[s]), int(head[s]), int(first[s])
        _tree(place[f:f + k].tolist(), common[h:h + k - 1].tolist(), lefts, min_length, out)
    found = np.array(out, dtype=np.int64).reshape(-1, 3)
    start = np.concatenate([np.minimum(a, b)[ok], found[:, 0]])
    length = np.concatenate([(p + match)[ok], found[:, 1]])
    period = np.concatenate([p[ok], found[:, 2]])
    o = np.lexsort((period, start))
    return start[o], length[o], period[o]


def _collapse(words: Words, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of all texts, joined by one space, and each text's offsets.

    A word goes if a run holds it after the run's first period.
    """
    n = len(words.hash)
    depth = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.flatnonzero(np.cumsum(depth[:n]) == 0)
    text = np.searchsorted(words.first, kept, side="right") - 1
    spaced = np.flatnonzero(text[1:] == text[:-1])  # kept words with another one after them
    data = words.data.copy()
    mark = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(mark, words.start[kept], 1)
    np.add.at(mark, words.end[kept], -1)
    stays = np.cumsum(mark[:-1]) > 0
    blank = words.end[kept[spaced]]  # the white space after such a word stays, as one space
    data[blank] = 0x20
    stays[blank] = True
    before = np.concatenate([[0], np.cumsum(stays)])
    return data[stays], before[words.offsets]


def _find(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = Words(b.column("text"), lower=False)
            start, length, period = word_runs(words, min_length)
            data, offsets = _collapse(words, start, length, period)
            text = np.searchsorted(words.first, start, side="right") - 1
            ends = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(start - words.first[text]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            collapsed = pa.StringArray.from_buffers(b.num_rows, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(ends, runs), collapsed],
                                             ["row", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, min_length: int = 12, columns: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (struct ``row``: all its columns, or ``columns``) with the runs of its ``text``.

    ``runs``: (start, length, period) in words, by start then period, of all runs
    of at least ``min_length`` words and two periods; ``collapsed``: the words
    that no run holds after its first period, joined by one space; ``n_words``.
    One row out per row in, whatever its ids, whether repeated or null; a null
    or empty text has no words, no runs and an empty ``collapsed``.  A text is
    looked at whole by one task, whatever its length (about 200 bytes of memory
    a word); an empty table gives an empty result; columns may have any name.
    """
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    row = F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    s = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_find(min_length), s)


def planted(text: Column, doc_id: Column) -> Column:
    """The text; of every tenth document (by CRC-32 of its id) the words from a point on repeat with one period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def change(w: Column) -> Column:
        n = F.size(w)
        a = F.when(n > 0, g % F.when(n > 0, n)).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return bind(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.concat(
            F.slice(w, 1, x["a"]), F.transform(F.sequence(F.lit(0), n - x["a"] - 1), lambda i: F.get(w, x["a"] + i % x["p"]))), " "))

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    return F.when(h % 10 == 0, bind(words, lambda w: F.when(F.size(w) > 0, change(w)).otherwise(F.lit("")))).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", planted(F.col("text").cast("string"), F.col("doc_id")).alias("text"))
    got = periodic_runs(docs, columns=["doc_id"])
    # longest first, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    got = got.withColumn("best", best)
    return got.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
                      (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"),
                      F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
