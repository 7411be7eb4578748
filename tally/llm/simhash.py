"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distance.

A fingerprint of 64 bits is cut into ``max_bits + 2`` blocks.  Fingerprints
that differ in at most ``max_bits`` bits agree on two whole blocks at least, so
every such pair meets under one of the C(max_bits + 2, 2) block pairs.  Only
distinct fingerprints are joined (copies were grouped before), a bucket gives a
spanning forest of its links instead of all its pairs, and a bucket with more
than ``bucket`` fingerprints is dealt to tasks by pairs of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import fp_hex, keep, partitions, read
from tally.llm.graph import connected_components

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text's word shingles (no word: zero)."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change; white space is ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        start = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=start[1:])
        ends = (start[shingle:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(start.tolist(), ends)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(fp.view(np.int64))], ["doc_id", "digest", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, digest, fp)`` of every row; ``fp`` is the fingerprint as a signed long, ``digest`` a hash of the text."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, digest long, fp long")


def block_masks(max_bits: int) -> list[int]:
    """Masks of all pairs of ``max_bits + 2`` near-equal blocks of 64 bits."""
    if not 0 <= max_bits <= 30:
        raise ValueError("max_bits must be between 0 and 30")
    m = max_bits + 2
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links within ``max_bits`` that join what such links connect (positions; at most n - 1)."""
    left = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= max_bits
            if near.any():
                got = left[near].tolist()
                links += [(x, y) for y in got]
                queue += got
                left = left[~near]
    return links


def _bucket_links(max_bits: int):
    """Rows sorted by bucket -> links between fingerprints of one bucket."""
    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(cuts, len(fp)))
        a, b = [], []
        small = np.repeat(sizes <= 8, sizes)
        group = np.repeat(np.arange(len(cuts)), sizes)
        for d in range(1, min(8, int(sizes.max()))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
            a.append(fp[i])
            b.append(fp[i + d])
        for g in np.flatnonzero(sizes > 8):
            part = fp[cuts[g]:cuts[g] + sizes[g]]
            pairs = np.array(forest(part, max_bits), dtype=np.int64).reshape(-1, 2)
            a.append(part[pairs[:, 0]])
            b.append(part[pairs[:, 1]])
        none = np.zeros(0, dtype=np.uint64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            u, v = links(k, f)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "v", "p", "q")], axis=1)
            f = batch.column("fp").to_numpy().view(np.uint64)
            held_k, held_f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            last = np.flatnonzero((held_k != held_k[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield out(held_k[:cut], held_f[:cut])
                held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_f):
            yield out(held_k, held_f)
    return run


#: Bytes of a shuffled row of ``near_links``.
ROW_BYTES = 56


def near_links(fps: DataFrame, max_bits: int = 4, bucket: int = 4096, rows_at_most: int = 0) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that connect all within ``max_bits`` bits.

    ``rows_at_most``: a bound of their number; the partitions follow it.
    """
    masks = block_masks(max_bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"))
                               for i, m in enumerate(masks)])).alias("k")
    rows = fps.select("fp", keys).select("fp", "k.i", "k.v")
    shared = rows.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / bucket).cast("long")
    dealt = (rows.join(shared, ["i", "v"])
             .withColumn("c", F.pmod(F.xxhash64("fp"), chunks))
             .withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
             .select("i", "v", F.least("c", "d").alias("p"), F.greatest("c", "d").alias("q"), "fp"))
    n = partitions(fps, rows_at_most * len(masks) * ROW_BYTES)
    return (dealt.repartition(n, "i", "v", "p", "q").sortWithinPartitions("i", "v", "p", "q")
            .mapInArrow(_bucket_links(max_bits), "u long, v long"))


def _roots(rows: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """``(fp, root, first)`` of kept ``rows``: each fingerprint's component and its own first row (ids first, nulls last)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    distinct = rows.groupBy("fp").agg(first)
    nodes = connected_components(near_links(distinct.select("fp"), max_bits, bucket, rows.count()))
    return distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, bucket: int = 4096) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` of every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of
    fewer than ``shingle`` words is one shingle, a null or empty text has
    fingerprint zero and is linked like any other.  ``component_id`` is the
    smallest ``doc_id`` reachable over links of at most ``max_bits`` differing
    bits.  Rows with a null ``doc_id`` take part and never give the smallest
    (null where a component has no other); repeated rows are kept; an empty
    table gives an empty result; a text of any length has one fingerprint of all
    its words; other columns are not read.
    """
    rows = keep(fingerprints(docs, shingle))
    roots = _roots(rows, max_bits, bucket)
    first = roots.groupBy("root").agg(F.min("first").alias("first"))
    of = roots.select("fp", "root").join(first, "root").select("fp", F.col("first.doc_id").alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", fp_hex("fp").alias("fingerprint"), "component_id")


def simhash_keep_first(docs: DataFrame, shingle: int = 4, max_bits: int = 4, bucket: int = 4096) -> DataFrame:
    """One row of each group, with all columns of ``docs``: the one with the smallest ``doc_id``.

    Among rows with that id, or in a group without ids, the smallest hash of the
    text decides; of rows equal in both one stays.  Null, empty and very long texts
    as in ``simhash_groups``; an empty table stays empty; columns may have any name.
    """
    rows = keep(fingerprints(docs, shingle))
    first = _roots(rows, max_bits, bucket).groupBy("root").agg(F.min("first").alias("first"))
    chosen = keep(first.select(F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"),
                      F.xxhash64(F.col("text").cast("string")).alias("_digest"))
    match = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_digest"] == b["_digest"])
    kept = row.join(chosen, match(row, chosen), "left_semi")
    again = rows.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.join(chosen, match(again, chosen), "left_semi").isEmpty():
        kept = kept.dropDuplicates(["_id", "_digest"])
    return kept.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
