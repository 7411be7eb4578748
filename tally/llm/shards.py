"""Shuffled shards in two passes: scatter into memory-sized buckets, then Fisher-Yates in each.

Pass one sends every record to a bucket by seeded hashes: the shard by
rendezvous hashing of the record's id, the bucket in it by a hash of id and
text.  Pass two permutes each bucket in one task's memory and writes it.  A
shard is its buckets one after another; a record's slot is its place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import keep, read

LAW = "key"
#: Up to so many buckets (two longs each) their offsets are broadcast; beyond, they are joined by shuffle.
MAX_BROADCAST = 500_000


def shard_of(doc_id: Column, shards: int, seed: int = 0) -> Column:
    """Rendezvous hash: the shard with the highest hash of (id, shard number).

    With one more shard a row stays unless the new one's hash is the highest.
    """
    votes = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), doc_id).alias("h"), F.lit(-i).alias("i")) for i in range(shards)]
    return -F.array_max(F.array(*votes))["i"]


def _permute(seed: int):
    """Rows sorted by bucket: each bucket in a random order, with its places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table):
            bucket = rows.column("bucket")[0].as_py()
            order = np.random.default_rng((seed, bucket)).permutation(len(rows))  # Fisher-Yates
            rows = rows.take(pa.array(order)).append_column("place", pa.array(np.arange(len(rows))))
            return rows.to_batches(max_chunksize=1000)

        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, e in zip(cuts, cuts[1:]):
                if held and held[0].column("bucket")[0].as_py() != bucket[a]:
                    yield from out(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(a, e - a))
        if held:
            yield from out(pa.Table.from_batches(held))
    return run


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 0, bucket_bytes: int = 32 << 20) -> DataFrame:
    """All rows of ``docs`` (struct ``row``) with ``shard``, ``slot``, ``grown_shard`` and ``size``, written as Parquet.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1.  The files are cut by
    shard, each bucket's rows in order.  Law ``key``: id and shard count alone
    decide the shard.  A null id is a key like any other; rows equal in id and
    text are interchangeable and share a bucket; an empty table gives an empty
    result; a very long text makes its bucket larger by itself; columns may have any name.
    """
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    total = docs.select(F.sum(size).alias("n")).first()["n"] or 0
    each = max(1, -(-total // (shards * bucket_bytes)))  # buckets of a shard
    part = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), text), F.lit(each))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, size.alias("size"), shard_of(F.col("doc_id"), shards, seed).alias("shard"),
                       shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
                       part.alias("part"), F.xxhash64("doc_id", text).alias("tie"))
    rows = rows.select("row", "size", "shard", "grown_shard", (F.col("shard") * F.lit(each) + F.col("part")).alias("bucket"), "tie")
    schema = rows.drop("tie").schema.add("place", "long")
    # sorted by content first, so the order of arrival doesn't matter
    dealt = rows.repartition(shards * each, "bucket").sortWithinPartitions("bucket", "tie", "row.doc_id").drop("tie")
    written = keep(dealt.mapInArrow(_permute(seed), schema), by="shard")
    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    if shards * each <= MAX_BROADCAST:  # a row a bucket: the written rows needn't be shuffled to meet them
        offsets = F.broadcast(offsets)
    return (written.join(offsets, "bucket")
            .select("row", "size", "shard", (F.col("offset") + F.col("place")).alias("slot"), "grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    got = shuffle_into_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
