"""Shared helpers: cutting lineage, Arrow text views, vectorised word hashes.

Nothing here holds more than one Arrow batch of texts at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import ensure_checkpoint_dir, shuffle_partitions_for

#: ASCII white space that separates words (space, tab .. carriage return).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_WORD = np.ones(256, dtype=bool)
_WORD[list(SPACES)] = False
#: Bytes of letters, digits and all non-ASCII characters.
_ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: ASCII lower-casing of bytes.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240113).integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (all output bits depend on all input bits)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand in each worker."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, b in (("up", _BASE), ("down", _BASE_INV)):
                a = np.full(n, b, dtype=np.uint64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P and inverse powers D: hash of data[a:b] is mix64((P[b] - P[a]) * D[a])."""
    up, down = _Powers.get(len(data) + 1)
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[:-1], out=p[1:])
    return p, down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch, one after another, and each text's offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes each (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a batch of texts: byte spans, 64-bit hashes and each text's first word.

    ``first[i]`` .. ``first[i + 1]`` are the words of text i.  A word is a run of
    bytes that are not ASCII white space (``alnum``: ASCII letters and digits and
    anything beyond ASCII); it never crosses texts.
    """

    def __init__(self, column: pa.Array, lower: bool = True, alnum: bool = False):
        data, self.offsets = text_bytes(column)
        if lower:
            data = _LOWER[data]
        self.data = data
        inside = (_ALNUM if alnum else _WORD)[data]
        begin, end = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            o = self.offsets
            heads = o[:-1][o[:-1] < o[1:]]
            tails = o[1:][o[:-1] < o[1:]] - 1
            begin[heads] = inside[heads]
            end[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        p, down = prefix_hash(data)
        self.hash = mix64((p[self.end] - p[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they all lie in one text."""
        k = len(self.hash)
        ok = np.zeros(k, dtype=bool)
        out = np.zeros(k, dtype=np.uint64)
        if k >= n:
            m = k - n + 1
            acc = np.full(m, n, dtype=np.uint64)
            for j in range(n):
                acc = mix64(acc * _BASE + self.hash[j:j + m])
            out[:m] = acc
            last = np.repeat(self.first[1:], np.diff(self.first))  # end of each word's text
            ok[:m] = np.arange(m) + n <= last[:m]
        return out, ok

    def ngrams_at(self, n: int, at: int, count: int) -> np.ndarray:
        """Hashes of the ``count`` n-grams from word ``at`` on."""
        acc = np.full(count, n, dtype=np.uint64)
        for j in range(n):
            acc = mix64(acc * _BASE + self.hash[at + j:at + j + count])
        return acc


def suffix_ranks(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, and each doubling's ranks: ``levels[k]`` are equal where the next 2**k words are.

    ``key`` names the words (different texts share none), ``end`` is the end of each word's text.
    """
    n = len(key)
    order = np.argsort(key, kind="stable").astype(np.int32)
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    at = np.arange(n, dtype=np.int32)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels, step = [rank], 1
    tied = ~new
    tied[:-1] |= ~new[1:]
    act = order[tied]
    while len(act):
        after = act.astype(np.int64) + step
        second = np.where(after < end[act], rank[np.minimum(after, n - 1)] + 1, 0)
        pair = (rank[act].astype(np.int64) << 32) | second
        o = np.argsort(pair, kind="stable")
        act, pair = act[o], pair[o]
        old = rank[act]
        t = np.arange(len(act), dtype=np.int32)
        split, group = np.ones(len(act), dtype=bool), np.ones(len(act), dtype=bool)
        split[1:], group[1:] = pair[1:] != pair[:-1], old[1:] != old[:-1]
        head = np.maximum.accumulate(np.where(group, t, 0))
        order[old + t - head] = act
        rank = rank.copy()
        rank[act] = old + np.maximum.accumulate(np.where(split, t, 0)) - head
        levels.append(rank)
        step *= 2
        tied = ~split
        tied[:-1] |= ~split[1:]
        act = act[tied]
    return order, levels


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table (cut by column ``by``) to the shared checkpoint folder and read it back: cuts lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a later
    step reads finished files, so losing an executor never recomputes what came
    before.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tally-llm-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tally_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote and nothing reads any more."""
    path = getattr(df, "_tally_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bind(value, body):
    """``body(value)`` as one expression that evaluates ``value`` once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, size: int = 0) -> int:
    """Shuffle partitions for ``size`` bytes: the session's, or more where those would hold too much each."""
    return shuffle_partitions_for(size, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fp_hex(col) -> F.Column:
    """A 64-bit integer as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
