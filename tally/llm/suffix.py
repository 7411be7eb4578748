"""Removing repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere
else, in the same text or another.  How the work is dealt out:

1. Every ``length``-byte string is assigned to its *anchor*, the leftmost
   smallest hash among its ``gram``-byte substrings.  Equal strings have equal
   anchors.  Consecutive strings with one anchor form a *superstring*.
2. Only anchors seen at least twice can hold a repeated string.  A bit filter
   of fixed size (a documented parameter; it may pass too much, never too
   little) tells the second scan which superstrings to emit.
3. Equal superstrings are grouped with their count before anything is dealt by
   anchor, so copies in any number are one row.
4. The distinct superstrings of an anchor meet in one task.  Their suffix array
   is built by two-stage sorting: only suffixes smaller than their successor
   are sorted directly, the others are induced by one scan over the buckets of
   first bytes.  Adjacent suffixes with a common prefix of ``length`` bytes are
   repeated strings.
5. An anchor whose distinct superstrings exceed ``hot_bytes`` is split further,
   by the whole ``length``-byte string: its strings are counted one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import keep, mix64, partitions, prefix_hash, read, slices, text_bytes

_PLACE = np.uint64((1 << 30) - 1)  # low bits of a key hold the position in a batch


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n, step = len(a) - width + 1, 1
    while step * 2 <= width:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    return np.minimum(a[:n], a[width - step:width - step + n])


def superstrings(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of starts of one anchor: text number, first start, last start (in ``data``), anchor hash."""
    none = np.zeros(0, dtype=np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    p, down = prefix_hash(data)
    h = mix64((p[gram:] - p[:-gram]) * down[:n - gram + 1])
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(key, length - gram + 1) & _PLACE).astype(np.int64)
    starts = n - length + 1
    past = np.zeros(n + 1, dtype=np.int32)  # starts whose string would leave its text
    np.add.at(past, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(past, offsets[1:], -1)
    good = np.cumsum(past[:starts]) == 0
    new = np.ones(starts, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~good[:-1]
    last = np.ones(starts, dtype=bool)
    last[:-1] = new[1:] | ~good[1:]
    first, end = np.flatnonzero(new & good), np.flatnonzero(last & good)
    text = np.searchsorted(offsets, first, side="right") - 1
    return text, first, end, h[anchor[first]]


def _count_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, n = np.unique(superstrings(*text_bytes(b.column("text")), length, gram)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
    return run


def _filter_pieces(bits: int, pieces: int):
    """Rows (piece, slot) -> one bit map for each piece of the filter in this task."""
    size = (1 << bits) // pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            piece, slot = (b.column(c).to_numpy() for c in ("piece", "slot"))
            for p in np.unique(piece):
                m = maps.setdefault(int(p), np.zeros(size, dtype=bool))
                m[slot[piece == p] % size] = True
        for p, m in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(m, bitorder="little").tobytes()])], ["piece", "bits"])
    return run


def anchor_filter(repeated: DataFrame, bits: int, pieces: int = 256) -> bytes:
    """Bit map of ``h`` modulo 2**bits: 2**bits / 8 bytes at most, however many rows there are."""
    slot = F.pmod(F.col("h"), F.lit(1 << bits))
    rows = repeated.select(slot.alias("slot")).withColumn("piece", F.floor(F.col("slot") / ((1 << bits) // pieces)))
    got = (rows.select("piece", "slot").repartition(partitions(rows), "piece")
           .mapInArrow(_filter_pieces(bits, pieces), "piece long, bits binary"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    step = len(out) // pieces
    for r in got.toLocalIterator():
        out[r.piece * step:(r.piece + 1) * step] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.tobytes()


_OCCURRENCE = "kid binary, key binary, at long, h long, size int, body binary"


def _emit(filter_, bits: int, length: int, gram: int, remember: int = 200_000):
    """Superstrings whose anchor passes the filter; a body only when this task meets it first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        bitmap = np.frombuffer(filter_.value, dtype=np.uint8)
        low = np.uint64((1 << bits) - 1)
        for b in slices(batches):
            data, offsets = text_bytes(b.column("text"))
            text, first, last, h = superstrings(data, offsets, length, gram)
            slot = (h & low).astype(np.int64)
            ok = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            text, first, last, h = text[ok], first[ok], last[ok], h[ok]
            raw = memoryview(data.tobytes())
            keys = {i: hashlib.sha256(raw[offsets[i]:offsets[i + 1]]).digest()[:16] for i in np.unique(text).tolist()}
            kid, body, size = [], [], []
            for a, e in zip(first.tolist(), (last + length).tolist()):
                s = raw[a:e]
                k = xxhash.xxh3_128_digest(s)
                kid.append(k)
                size.append(e - a)
                if k in seen:
                    body.append(None)
                else:
                    if len(seen) >= remember:
                        seen.clear()
                    seen.add(k)
                    body.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(kid, pa.binary()), pa.array([keys[i] for i in text.tolist()], pa.binary()),
                pa.array(first - offsets[text]), pa.array(h.view(np.int64)), pa.array(size, pa.int32()),
                pa.array(body, pa.binary())], ["kid", "key", "at", "h", "size", "body"])
    return run


def _sort_direct(word: np.ndarray, at: np.ndarray, rounds: int) -> np.ndarray:
    """Suffixes ``at`` sorted by their first ``8 * rounds`` bytes, eight at a time among ties."""
    k = word[at].byteswap()
    order = np.argsort(k, kind="stable")
    at, k = at[order], k[order]
    tie = np.concatenate([[False], k[1:] == k[:-1], [False]])  # tie[i]: element i equals element i - 1
    for r in range(1, rounds):
        place = np.flatnonzero(tie[:-1] | tie[1:])
        if not len(place):
            break
        group = np.cumsum(~tie[:-1])[place]
        k = word[at[place] + 8 * r].byteswap()
        split = (group[1:] == group[:-1]) & (k[1:] != k[:-1])
        if not split.any():
            continue
        mixed = np.isin(group, group[1:][split])
        place, group, k = place[mixed], group[mixed], k[mixed]
        order = np.lexsort((k, group))
        at[place] = at[place][order]
        k = k[order]
        tie[place[1:]] = (group[1:] == group[:-1]) & (k[1:] == k[:-1])
    return at


def suffix_order(text: np.ndarray, active: np.ndarray, below: np.ndarray, rounds: int) -> np.ndarray:
    """Active positions of ``text`` in the order of their suffixes (to ``8 * rounds`` bytes at least).

    ``below[i]``: suffix i is smaller than its successor.  Such suffixes are sorted
    directly.  The others follow from one scan: bucket by bucket of first bytes,
    the larger predecessors of what is already in order come in that order.
    ``active`` must hold, with a position that isn't below, its successor too.
    """
    word = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    direct = _sort_direct(word, np.flatnonzero(active & below), rounds)
    cuts = np.searchsorted(text[direct], np.arange(257))
    larger = active & ~below
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        level = np.concatenate(induced[c]) if induced[c] else np.zeros(0, dtype=np.int64)
        bucket = [level]
        while len(level):  # runs of the byte c itself
            level = level[level > 0] - 1
            level = level[larger[level] & (text[level] == c)]
            bucket.append(level)
        bucket.append(direct[cuts[c]:cuts[c + 1]])
        here = np.concatenate(bucket)
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            heads = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            for a, e in zip(heads.tolist(), np.append(heads[1:], len(byte)).tolist()):
                induced[byte[a]].append(before[a:e])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, which of its ``length``-byte strings start elsewhere in these bodies too."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    text = np.frombuffer(b"\0".join(bodies) + b"\0\xff" + bytes(length + 16), dtype=np.uint8)
    head = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    end = int((sizes + 1).sum())
    change = np.flatnonzero(text[1:] != text[:-1])  # last place of each run of one byte
    lengths = np.diff(np.concatenate([[-1], change]))
    rising = np.repeat(text[change] < text[change + 1], lengths)
    below = np.zeros(len(text), dtype=bool)
    below[:len(rising)] = rising
    valid = np.zeros(end + 2, dtype=np.int32)
    some = sizes >= length
    np.add.at(valid, head[some], 1)
    np.add.at(valid, (head + sizes - length + 1)[some], -1)
    valid = np.cumsum(valid) > 0
    marks = np.zeros(end + 2, dtype=bool)
    direct = np.flatnonzero(below)
    last = (head + sizes - length)[some]
    reach = direct[np.searchsorted(direct, last)]  # the terminator rises, so there is one
    active = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(active, head[some], 1)
    np.add.at(active, reach + 1, -1)
    active = np.cumsum(active)[:len(text)] > 0
    order = suffix_order(text, active, below, -(-length // 8))
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    word = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    for r in [*range(0, length - 7, 8), length - 8]:  # common prefixes of neighbours, eight bytes at a time
        same = word[a + r] == word[b + r]
        a, b = a[same], b[same]
    marks[a] = marks[b] = True
    return [marks[h:h + max(0, s - length + 1)] for h, s in zip(head.tolist(), sizes.tolist())]


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _mark(length: int, chunk: int = 1 << 20):
    """Rows sorted by anchor: (kid, first, last) runs of repeated starts of each superstring."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []
        kept_bytes = 0

        def work(rows):
            kid, first, last = [], [], []
            alone = {}
            for h, *_ in rows:
                alone[h] = h not in alone
            several = [r for r in rows if not alone[r[0]]]
            marks = iter(repeated_starts([r[3] for r in several], length)) if several else iter(())
            for h, k, n, body in rows:
                m = None if alone[h] else next(marks)
                if n > 1:  # the whole superstring occurs again
                    a, b = [0], [len(body) - length]
                elif m is None:
                    continue
                else:
                    a, b = (x.tolist() for x in _runs(m))
                kid += [k] * len(a)
                first += a
                last += b
            return pa.RecordBatch.from_arrays([pa.array(kid, pa.binary()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["kid", "first", "last"])

        for batch in batches:
            for h, k, n, body in zip(*(batch.column(c).to_pylist() for c in ("h", "kid", "n", "body"))):
                if kept_bytes > chunk and held[-1][0] != h:
                    yield work(held)
                    held, kept_bytes = [], 0
                held.append((h, k, n, body))
                kept_bytes += len(body)
        if held:
            yield work(held)
    return run


def _mark_hot(kids: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many superstrings: counts of each string by two 64-bit hashes."""
    each = kids.select("kid", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - length)).alias("first"), "body")
    piece = F.substring(F.col("body"), F.col("first").cast("int") + 1, F.lit(length))
    each = each.select("kid", "n", "first", F.xxhash64(piece).alias("a"), F.xxhash64(F.lit(length), piece).alias("b"))
    again = each.groupBy("a", "b").agg(F.sum("n").alias("all")).where("all > 1").select("a", "b")
    return each.join(again, ["a", "b"], "left_semi").select("kid", "first", F.col("first").alias("last"))


def text_key(text: Column) -> Column:
    """First half of a text's SHA-256: equal texts have equal keys."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 50, filter_bits: int = 27,
                   hot_bytes: int = 8 << 20) -> DataFrame:
    """``(key, spans)`` of every distinct text with bytes to remove; spans: unsorted ``[lo, hi)`` byte ranges."""
    if not 8 <= gram <= length:
        raise ValueError("gram must be from 8 to length")
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    anchors = texts.mapInArrow(_count_anchors(length, gram), "h long, n long")
    repeated = anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    shared = spark.sparkContext.broadcast(anchor_filter(repeated, filter_bits))
    seen = keep(texts.mapInArrow(_emit(shared, filter_bits, length, gram), _OCCURRENCE))
    kids = keep(seen.groupBy("kid").agg(F.count(F.lit(1)).alias("n"), F.first("h").alias("h"), F.first("size").alias("size"),
                                        F.first("body", ignorenulls=True).alias("body")))
    hot = kids.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > hot_bytes).select("h")
    split = not hot.isEmpty()
    usual = kids.join(hot, "h", "left_anti") if split else kids
    stored = kids.agg(F.sum("size")).first()[0] or 0
    marks = (usual.select("h", "kid", "n", "body").repartition(partitions(docs, stored), "h").sortWithinPartitions("h")
             .mapInArrow(_mark(length), "kid binary, first long, last long"))
    if split:
        marks = marks.union(_mark_hot(kids.join(hot, "h", "left_semi"), length))
    spans = (seen.select("kid", "key", "at").join(marks, "kid")
             .select("key", (F.col("at") + F.col("first")).alias("lo"), (F.col("at") + F.col("last") + length).alias("hi"))
             .distinct())  # copies of a text share its spans
    return spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, runs, sha, kept = [], [], [], [], []
            for text, spans in zip(b.column("text"), b.column("spans")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ranges = sorted((s["lo"], s["hi"]) for s in spans.as_py()) if spans.is_valid else []
                parts, at, removed, n = [], 0, 0, 0
                for lo, hi in ranges:
                    if lo > at or (n == 0 and lo == 0):
                        parts.append(raw[at:lo])
                        n += 1
                        removed += hi - lo
                        at = hi
                    elif hi > at:
                        removed += hi - at
                        at = hi
                parts.append(raw[at:])
                left = b"".join(parts) if n else raw
                size.append(len(raw))
                gone.append(removed)
                runs.append(n)
                sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(text.as_py() if not n else left.decode("utf-8", "ignore"))
            cols = [b.column("row"), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(sha, pa.string())]
            names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = True, columns: list[str] | None = None, **how) -> DataFrame:
    """Each row of ``docs`` (struct ``row``: all its columns, or ``columns``) with what is left of its text.

    Adds ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` of the remaining bytes and, ``with_text``, ``kept``: the
    remaining bytes as text, where halves of a cut character are left out.
    Strings are judged on the input.  A null text is empty (``kept`` null);
    texts under ``length`` bytes lose nothing; equal rows are each other's
    repeats; null or repeated ids don't matter, rows are told apart by their
    text alone; a very long text is looked at whole; an empty table gives an
    empty result.
    """
    spans = repeated_spans(docs, length, **how).withColumnRenamed("key", "_key")
    row = F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("_key"))
    joined = rows.join(spans, "_key", "left").select("row", "text", "spans")
    return joined.mapInArrow(_cut(with_text), _schema(joined, with_text))


def _schema(joined: DataFrame, with_text: bool):
    s = T.StructType([joined.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return s.add("kept", T.StringType()) if with_text else s


def drop_repeats(docs: DataFrame, length: int = 200, **how) -> DataFrame:
    """``docs`` with its own columns; ``text`` is what is left, and ``n_chars``, if there is one, its length.

    A null text stays null; repeated rows are each other's repeats; ids may be null or
    repeat; very long texts are looked at whole; an empty table stays empty; columns
    may have any name.
    """
    got = remove_repeats(docs, length, **how)
    def value(c):
        if c == "text":
            return F.col("kept").alias("text")
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`")
    return got.select(*[value(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = remove_repeats(docs, with_text=False, columns=["doc_id"])
    return got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
