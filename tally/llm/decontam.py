"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

For every benchmark item of L words, windows of L words of every document are
compared with it; a document of fewer words is one window, whole.  Words are
lower-cased runs of letters and digits; shingles have five words (an item of
fewer words is one shingle).

* A window as similar as asked shares at least ``similarity`` of its shingles
  with the item, so only windows with that many shingles of the benchmark's
  items of L words are fingerprinted; no match is lost by that, of short
  documents neither.  The vocabulary
  is a bit filter of fixed size.
* Fingerprints are cut into ``radius + 1`` blocks.  Two within ``radius`` bits
  agree on a block, so joining windows and items on (L, block, value) finds all
  such pairs.  Equal windows are joined once, however many documents hold them.
* Candidates within the radius are verified by the exact weighted Jaccard
  similarity of their shingle counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import _BASE, Words, keep, mix64, read, slices

SHINGLE = 5
#: Bits two fingerprints may differ by.  Pairs of similarity 0.8 differ by 6 to 12 on average; simulated loss
#: beyond 24 is 0.01 % for items of 9 words cut by one, 0.001 % at most for longer ones (beyond 16: 8 % and 0.01 to 2 %).
RADIUS = 24
_WINDOW = "row_id long, size int, word_start long, n_words int, wid binary, fp long, shingles binary"


def simhash(shingles: np.ndarray) -> int:
    """Signed 64-bit fingerprint; a shingle weighs as often as it occurs."""
    ones = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def similarity_of(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed shingle lists."""
    x, y = Counter(np.frombuffer(a, "<u8").tolist()), Counter(np.frombuffer(b, "<u8").tolist())
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        w = Words(b.column("text"), alnum=True)
        rows = []
        for i, item in enumerate(b.column("item_id").to_pylist()):
            size = int(w.first[i + 1] - w.first[i])
            if size:
                n = min(SHINGLE, size)
                s = w.ngrams(n)[0][w.first[i]:w.first[i + 1] - n + 1]
                rows.append((item, size, simhash(s), s.astype("<u8").tobytes()))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["item_id", "size", "fp", "shingles"])


def sized(shingles: np.ndarray, size: int) -> np.ndarray:
    """Hashes of shingles as shingles of an item of ``size`` words."""
    return mix64(shingles + np.uint64(size * int(_BASE) & (1 << 64) - 1))


def windows_of(w: Words, vocabulary: np.ndarray, sizes: list[int], similarity: float):
    """(size, first word, words) of windows with enough shingles of items of ``size`` words.

    A window has ``size`` words, or all of a text of fewer.
    ``vocabulary`` is a bit map of all shingles and of all ``sized`` ones.
    """
    bits = np.uint64(len(vocabulary) * 8 - 1)

    def known(h: np.ndarray) -> np.ndarray:
        slot = (h & bits).astype(np.int64)
        return (vocabulary[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    lengths = np.diff(w.first)
    last = np.repeat(w.first[1:], lengths)
    hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in sizes:
        n = min(SHINGLE, size)
        if n not in hits:
            h, ok = w.ngrams(n)
            ok &= known(h)
            hits[n] = np.flatnonzero(ok), h[ok]
        at, h = hits[n]
        if not len(at):
            continue
        at = at[known(sized(h, size))]
        m = size - n + 1  # shingles of a window
        need = max(1, int(np.ceil(similarity * m - 1e-9)))
        if len(at) < need:
            continue
        short = np.flatnonzero((lengths < size) & (lengths - n + 1 >= need))
        held = np.searchsorted(at, w.first[short + 1]) - np.searchsorted(at, w.first[short])
        for t in short[held >= need].tolist():
            yield size, int(w.first[t]), int(lengths[t])
        # each window once: at[j] is its first shingle of the vocabulary, at[j + need - 1] lies in it too
        lo = np.maximum(at[need - 1:] - m + 1, np.concatenate([[0], at[:-1] + 1])[:len(at) - need + 1])
        hi = at[:len(at) - need + 1]
        lo = np.maximum(lo, w.first[np.searchsorted(w.first, hi, side="right") - 1])  # not before its text
        count = np.maximum(hi - lo + 1, 0)
        if count.sum():
            start = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            for s in start[start + size <= last[start]].tolist():
                yield size, s, size


def _windows(vocabulary, sizes, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(vocabulary.value, dtype=np.uint8)
        known: dict[bytes, int] = {}
        for b in slices(batches):
            w = Words(b.column("text"), alnum=True)
            rows = []
            ids = b.column("row_id").to_pylist()
            for size, s, words in windows_of(w, bitmap, sizes.value, similarity):
                n = min(SHINGLE, size)
                text = int(np.searchsorted(w.first, s, side="right")) - 1
                shingles = w.ngrams_at(n, s, words - n + 1)
                packed = shingles.astype("<u8").tobytes()
                wid = xxhash.xxh3_128_digest(packed)
                if wid not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[wid] = simhash(shingles)
                rows.append((ids[text], size, s - int(w.first[text]), words, wid, known[wid], packed))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["row_id", "size", "word_start", "n_words", "wid", "fp", "shingles"])
    return run


def blocks(radius: int):
    """Array of ``radius + 1`` (number, bits) blocks of ``fp``."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    def value(a, b):
        return F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), value(a, b).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([similarity_of(x, y) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())], dtype=float)
            ok = pa.array(s >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("wid"), b.column("size"), b.column("item_id"), b.column("distance"), pa.array(s)], ["wid", "size", "item_id", "distance", "similarity"]).filter(ok)
    return run


def matches(docs: DataFrame, items: DataFrame, similarity: float = 0.8, radius: int = RADIUS, filter_bits: int = 24) -> DataFrame:
    """``(row_id, item_id, similarity, distance, word_start, n_words)``: the best window per row id and item.

    ``docs`` needs ``row_id`` (long) and ``text``, ``items`` ``item_id`` and
    ``text``; other columns are not read.  Null and empty texts hold no window,
    a text of fewer words than an item is its one window for it (``n_words``);
    rows that share an id, null too, are one document's parts; repeated items
    each match; ties go to the more similar, then closer, then earlier window;
    either table empty gives an empty result; a very long text is searched whole.
    The filter is a bit map of
    2**filter_bits bits; the window sizes are the items' distinct word counts.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be in (0, 1]")
    spark = docs.sparkSession
    bench = keep(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
                 .mapInArrow(_items, "item_id long, size int, fp long, shingles binary"))
    # distinct sizes and filter slots: bounded by the longest item and by the filter
    sizes = sorted(r.size for r in bench.select("size").distinct().toLocalIterator())
    bitmap = np.zeros(1 << (filter_bits - 3), dtype=np.uint8)
    slots = bench.mapInArrow(_slots(filter_bits), "slot long").distinct()
    for r in slots.toLocalIterator():
        bitmap[r.slot >> 3] |= np.uint8(1 << (r.slot & 7))
    vocabulary, sizes = spark.sparkContext.broadcast(bitmap.tobytes()), spark.sparkContext.broadcast(sizes)
    texts = docs.select(F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    found = keep(texts.mapInArrow(_windows(vocabulary, sizes, similarity), _WINDOW))
    distinct = keep(found.groupBy("wid", "size").agg(F.first("fp").alias("fp"), F.first("shingles").alias("a")))
    left = distinct.select("wid", "size", "fp", F.explode(blocks(radius)).alias("k")).select("wid", "size", "fp", "k.block", "k.value")
    right = (bench.select("item_id", "size", F.col("fp").alias("item_fp"), F.explode(blocks(radius)).alias("k"), "shingles")
             .select("item_id", "size", "item_fp", "k.block", "k.value"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = (left.join(right, ["size", "block", "value"]).withColumn("distance", distance.cast("int"))
            .where(F.col("distance") <= radius).select("wid", "size", "item_id", "item_fp", "distance").distinct())
    whole = bench.select(F.col("item_id").alias("id"), F.col("size").alias("words"), F.col("fp").alias("its"), F.col("shingles").alias("b")).distinct()
    same = near["item_id"].eqNullSafe(whole["id"]) & (near["size"] == whole["words"]) & (near["item_fp"] == whole["its"])
    pairs = near.join(whole, same).join(distinct.select("wid", "size", "a"), ["wid", "size"]).select("wid", "size", "item_id", "distance", "a", "b")
    good = pairs.mapInArrow(_verify(similarity), "wid binary, size int, item_id long, distance int, similarity double")
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("near"), (-F.col("word_start")).alias("early"), "n_words")).alias("best")
    # by size too: as many words can be a short text to one item and a window of another's size in a longer text
    return (found.select("row_id", "wid", "word_start", "size", "n_words").join(good, ["wid", "size"]).groupBy("row_id", "item_id").agg(best)
            .select("row_id", "item_id", "best.similarity", (-F.col("best.near")).alias("distance"),
                    (-F.col("best.early")).alias("word_start"), "best.n_words"))


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(np.frombuffer(s, "<u8"), size) for s, size in zip(b.column("shingles").to_pylist(), b.column("size").to_pylist())]
            all_ = np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in each), *(sized(s, size) for s, size in each)])
            slot = np.unique(all_ & np.uint64((1 << bits) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot)], ["slot"])
    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose text holds no benchmark item.

    Rows are told apart by their text, so null or repeated ids don't matter and
    repeated rows share their fate; null and empty texts stay; very long texts are
    searched whole; an empty table stays empty, and without items all rows stay.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    bad = matches(keyed.select(F.xxhash64("text").alias("row_id"), "text"), items, **how).select("row_id").distinct()
    return keyed.join(bad, F.xxhash64(keyed["text"]) == bad["row_id"], "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return matches(docs, read(spark, sf_dir, "benchmark")).withColumnRenamed("row_id", "doc_id")
