"""Mixing sources to target weights, block by block.

1. The words of each source, its texts one after another in a seeded random
   order, are packed into blocks of a fixed number of words; a text lies in one
   or several blocks, and the last block of a source may be short.
2. A source's target is its weight's share of the mix, at most ``most`` times its
   words; what is over goes to the others by weight.  Its slots are as many
   blocks as its target needs, the last one cut to the word.
3. The slots of the whole mix are dealt to output shards of a fixed number of
   slots.  Every slot draws a source with the targets as odds, so a shard's
   counts are multinomial.  Slots drawn beyond a source's number go, in order, to
   the sources drawn too seldom, so every target is met exactly.
4. The i-th slot of a source takes the block at i of a pseudorandom permutation
   of the source's block numbers (a Feistel network that walks until it is in
   range), a new permutation for each pass over the source.
5. Slots and packed blocks are joined by source and block number.

Sources are a table like any other: nothing about them is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import Words, keep, mix64, partitions, read, slices

#: Weights of the sources in code-point order, over and over.
WEIGHTS = (3.0, 1.0, 2.0)
#: Cells of the table that finds the source of a drawn number.
CELLS = 4096


# -- permutations ---------------------------------------------------------------------


def _round(half: np.ndarray, key: np.ndarray, i: int, mask: np.ndarray) -> np.ndarray:
    return mix64(half ^ mix64(key + np.uint64(i))) & mask


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Place of each ``index`` in a pseudorandom permutation of 0 .. n - 1 named by ``key``."""
    x, n, key = (np.asarray(a).astype(np.uint64) for a in (index, n, key))
    bits = np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(np.float64))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = x.copy()
    todo = np.arange(len(x))
    while len(todo):  # on average fewer than four walks: the network's range is less than four times n
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = x[todo] >> h, x[todo] & m
        for i in reversed(range(4)) if inverse else range(4):
            a, b = (b ^ _round(a, k, i, m), a) if inverse else (b, a ^ _round(b, k, i, m))
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


# -- packing ---------------------------------------------------------------------------


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n = np.diff(Words(b.column("text"), lower=False).first)
        kept = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64())], [*kept, "size"])


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of sizes within a partition, by source; its rows are sorted by source."""
    last, held = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        sid, size = b.column("sid").to_numpy(), b.column("size").to_numpy()
        total = np.cumsum(size)
        cut = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
        base = np.repeat(total[cut] - size[cut], np.diff(np.append(cut, len(sid))))
        at = total - size - base
        if sid[0] == last:
            at[:cut[1] if len(cut) > 1 else None] += held
        last, held = sid[-1], int(at[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "at"])


def _in_order(rows: DataFrame, seed: int, tasks: int) -> DataFrame:
    """``rows`` (sid, doc_id, size, text_hash) with ``offset``: the words of the source before each.

    Sorted over all tasks by source and a seeded hash, so the order does not
    depend on how rows are dealt; rows alike in id and text are interchangeable,
    and a counter spreads them over tasks.
    """
    order = ["sid", "h", "doc_id", "text_hash", "tie"]
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash")).withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("h", "tie")
    part = keep(dealt.mapInArrow(_offsets, T.StructType([*dealt.schema, T.StructField("at", T.LongType())])).withColumn("part", F.spark_partition_id()))
    sums = part.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("sid", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return part.join(sums, ["sid", "part"]).withColumn("offset", F.col("before") + F.col("at")).drop("before", "at", "part")


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """``(sid, block, doc_id, text_hash, offset, head, first, words)``: the part of each text in each block.

    ``head``: its first word's place in the block; ``first``: that word's number in the text.
    """
    end = F.col("offset") + F.col("size")
    b = F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((end - 1) / block))).alias("block")
    p = placed.where("size > 0").select("*", b)
    start = F.greatest(F.col("offset"), F.col("block") * block)
    stop = F.least(end, (F.col("block") + 1) * block)
    return p.select("sid", "block", "doc_id", "text_hash", "offset", (start - F.col("block") * block).alias("head"),
                    (start - F.col("offset")).alias("first"), (stop - start).alias("words"))


# -- targets ---------------------------------------------------------------------------


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, size) with ``sid``, ``weight`` and ``target``.

    Sources count by code point, null last, and weigh ``weights``, repeating.  They
    share ``share`` of all sizes by weight; none gets more than ``most`` times its
    size, and the excess goes to the others by weight until none is above.

    The sources whose size is smallest for their weight are cut first: with them
    in that order, the last one that is cut divides those at their bound from
    those that share what is left.  One row a source, sorted in one task.
    """
    n = len(weights)
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % n).cast("int"))
    rows = (sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
            .withColumn("weight", pick).withColumn("bound", most * F.col("size")))
    up = Window.orderBy(F.col("bound") / F.col("weight"), "sid")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # a source is cut if, with all before it cut, its share of the rest is above its bound
    per = (share * F.sum("size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("per", per).withColumn("cut", F.col("per") * F.col("weight") > F.col("bound"))
    # the first source that isn't cut sets the share a weight; all later ones get it too
    level = F.min(F.when(~F.col("cut"), F.struct(F.col("bound") / F.col("weight"), "sid", "per"))).over(whole)["per"]
    return rows.select("sid", "source", "size", "weight", F.when(F.col("cut"), F.col("bound")).otherwise(F.least(F.col("bound"), level * F.col("weight"))).alias("target"))


def _needs(block: int, seed: int):
    """For each source: words to take, full passes, blocks, the slots of all passes, and where the last pass ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, size, target = (b.column(c).to_numpy() for c in ("sid", "size", "target"))
            take = np.rint(target).astype(np.int64)
            some = np.maximum(size, 1)
            passes, rest = take // some, take % some
            blocks = -(-size // block)
            tail = size - (blocks - 1) * block  # words of the last block
            place = permute(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), _key(sid, passes, seed), inverse=True)
            # slots before the short block hold ``block`` words each
            short = np.where(rest <= place * block, -(-rest // block), place + 1 + np.maximum(0, -(-(rest - place * block - tail) // block)))
            slots = passes * blocks + short
            names = ["sid", "passes", "blocks", "rest", "tail", "place", "slots"]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in (sid, passes, blocks, rest, tail, place, slots)], names)
    return run


def _key(sid: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    return mix64(mix64(sid.astype(np.uint64) + np.uint64(seed << 32)) + turn.astype(np.uint64))


def _take(block: int, seed: int):
    """Slots with the block they take and how many of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, i, passes, blocks, rest, tail, place = (b.column(c).to_numpy() for c in ("sid", "i", "passes", "blocks", "rest", "tail", "place"))
            turn, j = i // blocks, i % blocks
            got = permute(j, blocks, _key(sid, turn, seed))
            words = np.where(got == blocks - 1, tail, block)
            before = j * block - np.where(place < j, block - tail, 0)
            words = np.where(turn == passes, np.clip(rest - before, 0, words), words)
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), b.column("sid"), b.column("i"), pa.array(got), pa.array(words)],
                                             ["shard", "slot", "sid", "i", "block", "take"])
    return run


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _draw(needs: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``(shard, slot, sid, i)``: every slot of the mix with its source and its number among the source's slots."""
    spark = needs.sparkSession
    total = needs.agg(F.sum("slots").alias("n")).first()["n"] or 0
    upto = F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    odds = needs.where("slots > 0").select("sid", "slots", ((upto - F.col("slots")) / total).alias("low"), (upto / total).alias("high"))
    cell = F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.lit(CELLS - 1), F.ceil(F.col("high") * CELLS) - 1))).alias("cell")
    cells = odds.select("sid", "low", "high", cell)
    tasks = max(partitions(needs), -(-total // (64 * shard_slots)))
    slots = spark.range(0, total, 1, tasks).select(F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("slot"))
    u = _uniform(F.lit(seed), F.col("shard"), F.col("slot"))
    slots = slots.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = keep(slots.join(cells, "cell").where("u >= low AND u < high").select("shard", "slot", "sid"))
    # the multinomial counts of each shard, and each source's slots in the shards before
    counts = drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select("sid", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    here = Window.partitionBy("sid", "shard").orderBy("slot")
    numbered = keep(drawn.withColumn("k", F.row_number().over(here) - 1).join(heads, ["sid", "shard"])
                    .select("shard", "slot", "sid", (F.col("head") + F.col("k")).alias("i")).join(needs.select("sid", "slots"), "sid"))
    good = numbered.where("i < slots").select("shard", "slot", "sid", "i")
    # drawn too often: ranked by source and number, and given the places of those drawn too seldom by the same rank
    seen = counts.groupBy("sid").agg(F.sum("n").alias("seen"))
    gap = needs.select("sid", "slots").join(seen, "sid", "left").select("sid", "slots", F.coalesce("seen", F.lit(0)).alias("seen"))
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over = gap.where("seen > slots").select("sid", "slots", F.coalesce(F.sum(F.col("seen") - F.col("slots")).over(ahead), F.lit(0)).alias("base"))
    under = gap.where("seen < slots").select("sid", "slots", "seen", F.coalesce(F.sum(F.col("slots") - F.col("seen")).over(ahead), F.lit(0)).alias("base"))
    spare = (numbered.where("i >= slots").select("shard", "slot", "sid", "i").join(over, "sid")
             .select("shard", "slot", (F.col("base") + F.col("i") - F.col("slots")).alias("rank")))
    wanted = (under.select("sid", "seen", "base", F.explode(F.sequence(F.col("seen"), F.col("slots") - 1)).alias("i"))
              .select("sid", "i", (F.col("base") + F.col("i") - F.col("seen")).alias("rank")))
    return good.unionByName(spare.join(wanted, "rank").select("shard", "slot", "sid", "i"))


# -- the mix ---------------------------------------------------------------------------


class Mix:
    """``documents``: (doc_id, text_hash, source, size, offset, source_size, target) of every row.

    ``spans``: (shard, slot, sid, block, head, doc_id, text_hash, offset, first, words), the words of the mix in
    their places: slot by slot, and in a slot by ``head``.  ``offset`` with ``sid`` names a row that has words.
    """

    def __init__(self, documents: DataFrame, spans: DataFrame):
        self.documents, self.spans = documents, spans

    def texts(self, docs: DataFrame) -> DataFrame:
        """``spans`` with their ``text``: their words joined by one space."""
        whole = docs.select(F.col("doc_id").alias("of"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col("text").cast("string").alias("whole")).dropDuplicates(["of", "hash"])
        words = F.array_remove(F.split(F.col("whole"), "[\\x20\\x09-\\x0D]+"), "")
        j = self.spans.join(whole, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
        return j.select(*self.spans.columns, F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = 512,
        shard_slots: int = 8192, seed: int = 0) -> Mix:
    """The mix of all rows of ``docs`` (doc_id, source, text).

    A source's words in the mix are its target to the word (rounded), and a text's
    at most ``most`` times its size, rounded up to a whole number.  Null and
    empty texts have no words and are never taken; ids may be null or repeat; a
    null source is a source; a very long text spans many blocks and is never
    held whole after its words were counted; other columns are not looked at;
    an empty table gives an empty mix.  The result depends on rows and seed, not
    on how rows are dealt.
    """
    if share <= 0 or most < share or block < 1 or shard_slots < 1 or not weights or min(weights) <= 0:
        raise ValueError("share, block, shard_slots and weights must be positive, most not below share")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sized = keep(rows.mapInArrow(_sizes, T.StructType([*rows.drop("text").schema, T.StructField("size", T.LongType())])))
    found = keep(targets(sized.groupBy("source").agg(F.sum("size").alias("size")), share, most, weights))
    names = found.select("sid", "source")
    by_source = sized.withColumnRenamed("source", "s")
    known = by_source.join(names, F.col("s").eqNullSafe(F.col("source"))).select("sid", "doc_id", "text_hash", "size")
    tasks = max(partitions(docs), -(-sized.count() // 2_000_000))
    placed = keep(_in_order(known, seed, tasks))
    needs = found.select(F.col("sid").cast("long").alias("sid"), "size", "target").mapInArrow(
        _needs(block, seed), "sid long, passes long, blocks long, rest long, tail long, place long, slots long")
    needs = keep(needs)
    taken = (_draw(needs, shard_slots, seed).join(needs.drop("slots"), "sid")
             .select("shard", "slot", "sid", "i", "passes", "blocks", "rest", "tail", "place")
             .mapInArrow(_take(block, seed), "shard long, slot long, sid long, i long, block long, take long"))
    pieces = _pieces(placed.withColumn("sid", F.col("sid").cast("long")), block)
    spans = (taken.join(pieces, ["sid", "block"]).where("head < take")
             .select("shard", "slot", "sid", "block", "head", "doc_id", "text_hash", "offset", "first", F.least("words", F.col("take") - F.col("head")).alias("words")))
    documents = placed.join(found.withColumnRenamed("size", "source_size"), "sid").select(
        F.col("sid").cast("long").alias("sid"), "doc_id", "text_hash", "source", "size", "offset", "source_size", "target")
    return Mix(documents, spans)


def query(spark, sf_dir: str) -> DataFrame:
    got = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = got.spans.groupBy("sid", "offset").agg(F.sum("words").alias("taken"))
    # a row's words start where no other row's do
    mark = F.when(F.col("size") > 0, F.col("offset"))
    return (got.documents.withColumn("offset", mark).join(taken, ["sid", "offset"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
