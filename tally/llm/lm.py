"""Stupid-backoff scores from n-gram counts of the whole corpus.

    S(w | h) = count(h w) / count(h)             if count(h w) >= min_count
             = alpha * S(w | shorter h)          otherwise
    S(w)     = count(w) / words of the corpus

The relations: *blocks* of documents, and *count tables* cut by n-gram hash
into parts.  A block sends each part the distinct n-grams it holds with their
counts (one packed, sorted array a row, so a frequent n-gram is one entry a
block however often it occurs).  A part adds the counts up and joins the totals
back to what each block sent.  The block joins them to the n-grams of its
documents and sums the scores of each document.  Blocks and parts follow the
input's size, and every block and part fits a task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import Words, keep, read, slices


#: The upper 60 bits of a hash name an n-gram; even 10**13 distinct ones share one with odds of 1 in 10**5.
HASH_BITS = ~np.uint64(15)


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_run(values: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run of hashes, as differences, with its counts."""
    d = np.diff(values, prepend=np.uint64(0))
    a, b = pack(d), pack(counts.astype(np.uint32))
    return struct.pack("<q", len(a)) + a + b


def unpack_run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<q", raw)
    return np.cumsum(unpack(raw[8:8 + n], np.uint64), dtype=np.uint64), unpack(raw[8 + n:], np.uint32)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of hashes each one lies in; grows with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, block) -> each block's rows of a slice as one compressed Arrow message."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in slices(batches, most=16 << 20):
        block = b.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
        out = []
        for rows in np.split(order, cuts[1:]):
            part = b.select(["doc_id", "text"]).take(pa.array(rows))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                w.write_batch(part)
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(block[order][cuts]), pa.array(out, pa.binary())], ["block", "rows"])


def _texts(table: pa.Table) -> pa.Table:
    """The rows of a block."""
    rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows")])
    return rows.combine_chunks()


class _Block:
    """Distinct n-grams of a block's texts, and where each text's n-grams are among them."""

    def __init__(self, text: pa.ChunkedArray, order: int):
        self.order, self.sizes = order, []
        grams: list[list[np.ndarray]] = [[] for _ in range(order)]
        masks: list[list[np.ndarray]] = [[] for _ in range(order)]
        for b in slices(pa.table({"text": text}).to_batches()):
            w = Words(b.column("text"))
            self.sizes.append(np.diff(w.first))
            for n in range(1, order + 1):
                h, ok = w.ngrams(n)
                grams[n - 1].append(h[ok] & HASH_BITS)
                masks[n - 1].append(ok)
        none, never = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        self.sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes])
        self.starts = [np.concatenate([never, *m]) for m in masks]  # words that begin an n-gram
        self.grams = [np.concatenate([none, *g]) for g in grams]

    def distinct(self, n: int, places: bool = False):
        return np.unique(self.grams[n - 1], return_inverse=places, return_counts=not places)


def _send(order: int, parts: int):
    def run(key, table):
        block = _Block(_texts(table).column("text"), order)
        rows = []
        for n in range(1, order + 1):
            values, counts = block.distinct(n)
            p = _part(values, parts)
            cuts = np.flatnonzero(np.diff(p, prepend=-1))
            for a, e in zip(cuts.tolist(), np.append(cuts[1:], len(p)).tolist()):
                rows.append((int(p[a]), n, pack_run(values[a:e], counts[a:e])))
        cols = list(zip(*rows)) or [[]] * 3
        return pa.table({"part": pa.array(cols[0], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "n": pa.array(cols[1], pa.int32()), "run": pa.array(cols[2], pa.binary())})
    return run


def _total(key, table):
    """One part: totals of its n-grams, answered to each block in the order it sent them."""
    out = []
    n_of, blocks, runs = (table.column(c).to_pylist() for c in ("n", "block", "run"))
    for n in sorted(set(n_of)):
        mine = [i for i, x in enumerate(n_of) if x == n]
        got = [unpack_run(runs[i]) for i in mine]
        _, place = np.unique(np.concatenate([v for v, _ in got]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([c for _, c in got])).astype(np.int64)
        at = 0
        for i, (v, _) in zip(mine, got):
            out.append((blocks[i], key[0].as_py(), n, pack(total[place[at:at + len(v)]])))
            at += len(v)
    cols = list(zip(*out)) or [[]] * 4
    return pa.table({"block": pa.array(cols[0], pa.int64()), "part": pa.array(cols[1], pa.int64()),
                     "n": pa.array(cols[2], pa.int32()), "totals": pa.array(cols[3], pa.binary())})


def _score(order: int, min_count: int, alpha: float):
    def run(key, docs, answers):
        docs = _texts(docs)
        block = _Block(docs.column("text"), order)
        n_of, part, packed = (answers.column(c).to_pylist() for c in ("n", "part", "totals"))
        counts = []  # of the n-gram that begins at each word, 0 where none does
        for n in range(1, order + 1):
            of_n = [x for _, x in sorted((p, raw) for m, p, raw in zip(n_of, part, packed) if m == n)]
            totals = np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.int64) for x in of_n)])
            c = np.zeros(len(block.starts[n - 1]), dtype=np.int64)
            c[block.starts[n - 1]] = totals[block.distinct(n, places=True)[1]]
            counts.append(c)
        size = block.sizes
        words = int(size.sum())
        place = np.arange(words) - np.repeat(np.cumsum(size) - size, size)  # place of each word in its text
        score = np.zeros(words)
        bottom = np.ones(words, dtype=bool)  # not settled yet
        for n in range(order, 1, -1):
            w = np.flatnonzero(bottom & (place >= n - 1))
            whole = counts[n - 1][w - n + 1]
            seen = whole >= min_count
            score[w[seen]] += np.log10(whole[seen] / counts[n - 2][w[seen] - n + 1])
            score[w[~seen]] += np.log10(alpha)
            bottom[w[seen]] = False
        score[bottom] += np.log10(counts[0][bottom])  # less log10 of the corpus size, later
        text = np.repeat(np.arange(len(size)), size)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(size.astype(np.int64)),
                         "n_unigram": pa.array(np.bincount(text[bottom], minlength=len(size)).astype(np.int64)),
                         "part_score": pa.array(np.bincount(text, weights=score, minlength=len(size)))})
    return run


def backoff_scores(docs: DataFrame, order: int = 3, min_count: int = 2, alpha: float = 0.4, block_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, n_words, log10_score, log10_per_word)`` of every row, counts taken from all rows.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; n-grams
    don't cross texts; those of two and more words count if seen ``min_count``
    times.  Null and empty texts have score 0 and no mean.  Repeated rows count
    each time; null ids are ids; an empty table gives an empty result; a text of
    any length is scored whole in its block; other columns are not read.  ``block_bytes``: text bytes of a block.
    """
    if order < 1 or min_count < 1 or not 0 < alpha <= 1:
        raise ValueError("order and min_count must be positive, alpha in (0, 1]")
    text = F.col("text").cast("string")
    total = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = blocks * order
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("long").alias("block"))
    rows = rows.mapInArrow(_pack_texts, "block long, rows binary").repartition(blocks, "block")
    sent = rows.groupBy("block").applyInArrow(_send(order, parts), "part long, block long, n int, run binary")
    answers = sent.repartition(parts, "part").groupBy("part").applyInArrow(_total, "block long, part long, n int, totals binary")
    scored = keep(rows.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block"))
                  .applyInArrow(_score(order, min_count, alpha), "doc_id long, n_words long, n_unigram long, part_score double"))
    words = scored.select(F.sum("n_words").alias("n")).first()["n"] or 1
    score = F.col("part_score") - F.col("n_unigram") * F.log10(F.lit(float(max(words, 1))))
    return scored.select("doc_id", "n_words", score.alias("log10_score"), (score / F.when(F.col("n_words") > 0, F.col("n_words"))).alias("log10_per_word"))


def query(spark, sf_dir: str) -> DataFrame:
    got = backoff_scores(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("log10_score", "log10_per_word")])
