"""Grouping spelling variants with FM-index searches over the vocabulary.

Words one edit apart agree in one whole half: the search scheme matches a half
exactly and extends across the other, allowing one error.

1. The vocabulary and its counts come from all texts, counted before any shuffle.
2. Every word is dealt twice, by its first and by its last characters, so words
   that share a half meet.  A group of more than ``block`` words is dealt by word
   length and the longest part of a half that words of neighbouring length share
   (a word then asks three groups); one that still exceeds it is cut into blocks
   by hash, which every word of the group asks.
3. A task builds the FM-index of its words, written backwards between delimiters
   (those dealt by their last characters are already reversed: the index runs in
   both directions over the vocabulary).  A word's half is matched character by
   character as an interval of suffix ranks, then the rest with one replaced,
   deleted or inserted character.  All words of the task take a step together.
4. A word's form is its most frequent near word if that is frequent enough;
   roots follow forms by pointer jumping, in as many rounds as counts allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import discard, keep, partitions, read, suffix_ranks

#: Shortest word, and how many of its first and of its last characters deal it out (its halves have at least so many).
SHORTEST, ROUTE = 7, (3, 4)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters: ASCII ones and code points 0xC0 to 0xFF.
LETTERS = "a-z\\u00C0-\\u00FF"


# -- one task's index ---------------------------------------------------------------


class Index:
    """FM-index of words written backwards between delimiters.

    Reading a character narrows the rank interval of all suffixes that start with
    what was read so far, backwards, and the delimiter: the words that start so.
    """

    def __init__(self, words: list[str]):
        joined = "\0" + "".join(w[::-1] + "\0" for w in words)
        text = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        self.size = len(text)
        order, _ = suffix_ranks(text.astype(np.uint64), np.full(len(text), len(text), dtype=np.int64))
        self.order = order
        self.last = text[order - 1]  # the Burrows-Wheeler transform
        # the sorted (character, rank) pairs answer every count of a character before a rank
        self.keys = np.sort(self.last * self.size + np.arange(self.size))
        self.letters = np.unique(text)[1:]
        self.word_of = np.searchsorted(np.flatnonzero(text == 0), np.arange(self.size), side="right") - 1
        self.everything = int((text == 0).sum())

    def step(self, char: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after reading one more character each."""
        return np.searchsorted(self.keys, char * self.size + lo), np.searchsorted(self.keys, char * self.size + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ways to read one more letter: (which interval, letter, lo, hi), none of them empty."""
        size = hi - lo
        wide = size > 4 * len(self.letters)
        at, letter = [], []
        some = np.flatnonzero(~wide)
        if len(some):  # the letters that are there
            n = size[some]
            which = np.repeat(some, n)
            seen = self.last[np.repeat(lo[some] - (np.cumsum(n) - n), n) + np.arange(len(which))]
            pair = np.unique(which[seen > 0] * 0x110000 + seen[seen > 0])
            at.append(pair // 0x110000)
            letter.append(pair % 0x110000)
        some = np.flatnonzero(wide)
        if len(some):  # every letter
            at.append(np.repeat(some, len(self.letters)))
            letter.append(np.tile(self.letters, len(some)))
        if not at:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none
        i, c = np.concatenate(at), np.concatenate(letter)
        a, b = self.step(c, lo[i], hi[i])
        ok = a < b
        return i[ok], c[ok], a[ok], b[ok]

    def near(self, words: list[str], exact: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number, number of an indexed word) of all pairs one edit apart that agree in the first ``exact`` characters.

        ``inside``: the word is itself indexed, so an interval of one holds only it.
        """
        text = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        head = np.cumsum(size) - size
        q = np.arange(len(words))
        lo, hi = np.zeros(len(words), dtype=np.int64), np.full(len(words), self.everything, dtype=np.int64)
        pos = np.zeros(len(words), dtype=np.int64)
        held = []
        while len(q):  # the exact half
            done = pos == exact[q]
            held.append((q[done], lo[done], hi[done]))
            q, lo, hi, pos = q[~done], lo[~done], hi[~done], pos[~done]
            lo, hi = self.step(text[head[q] + pos], lo, hi)
            some = (lo < hi) & ~((hi - lo == 1) & inside[q])
            q, lo, hi, pos = q[some], lo[some], hi[some], pos[some] + 1
        q, lo, hi = map(np.concatenate, zip(*held)) if held else (q, lo, hi)
        some = ~((hi - lo == 1) & inside[q])
        q, lo, hi = q[some], lo[some], hi[some]
        pos = exact[q]
        none = np.zeros(0, dtype=np.int64)
        bad = (none, none, none, none)  # with the error: word, place, interval
        found_q, found_at = [], []
        while len(q) or len(bad[0]):
            # those with the error read on exactly, at the word's end the delimiter
            bq, bp, bl, bh = bad
            ended = bp == size[bq]
            char = np.where(ended, 0, text[np.minimum(head[bq] + bp, max(len(text) - 1, 0))]) if len(bq) else none
            bl, bh = self.step(char, bl, bh)
            ok = bl < bh
            hit = ok & ended
            found_q.append(bq[hit])
            found_at.append(bl[hit])
            on = ok & ~ended
            bad = (bq[on], bp[on] + 1, bl[on], bh[on])
            if not len(q):
                continue
            # those without: one error here, or read on
            ended = pos == size[q]
            char = np.where(ended, 0, text[np.minimum(head[q] + pos, len(text) - 1)])
            i, c, a, b = self.children(lo, hi)
            other = c != char[i]
            i, a, b = i[other], a[other], b[other]
            swap = ~ended[i]
            drop = ~ended
            bad = tuple(np.concatenate(x) for x in zip(
                bad, (q[i][swap], pos[i][swap] + 1, a[swap], b[swap]),      # replaced
                (q[i], pos[i], a, b),                                       # inserted before this place
                (q[drop], pos[drop] + 1, lo[drop], hi[drop])))              # deleted
            q, pos, lo, hi, char = q[drop], pos[drop], lo[drop], hi[drop], char[drop]
            lo, hi = self.step(char, lo, hi)
            some = (lo < hi) & ~((hi - lo == 1) & inside[q])
            q, pos, lo, hi = q[some], pos[some] + 1, lo[some], hi[some]
        fq, at = np.concatenate([none, *found_q]), np.concatenate([none, *found_at])
        # a rank of the delimiter before a word: its word follows
        pair = np.unique(fq * (self.everything + 1) + self.word_of[self.order[at]])
        return pair // (self.everything + 1), pair % (self.everything + 1)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's words against its own index, side by side."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    word, n = rows.column("s").to_pylist(), rows.column("n").to_numpy()
    back, indexed = rows.column("back").to_numpy(zero_copy_only=False), rows.column("indexed").to_numpy(zero_copy_only=False)
    for side in (False, True):
        # a word may ask several groups of this partition, but asks their one index once
        mine = np.flatnonzero(back == side)
        mine = mine[np.argsort(~indexed[mine], kind="stable")]
        at = np.array(list({word[i]: i for i in mine[::-1].tolist()}.values()), dtype=np.int64)
        known = at[indexed[at]]
        if not len(known):
            continue
        index = Index([word[i] for i in known])
        for a in range(0, len(at), 50_000):
            some = at[a:a + 50_000]
            asked = [word[i] for i in some]
            half = np.fromiter(((len(w) + side) // 2 for w in asked), dtype=np.int64, count=len(asked))
            q, k = index.near(asked, half, indexed[some])
            u, v, m = [], [], []
            for i, j, c in zip(q.tolist(), k.tolist(), n[known[k]].tolist()):
                x, y = asked[i], word[known[j]]
                if side:
                    x, y = x[::-1], y[::-1]
                    if x[:len(x) // 2] == y[:len(x) // 2]:
                        continue  # the other side finds this pair
                u.append(x)
                v.append(y)
                m.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(m, pa.int64())], ["word", "near", "near_n"])


# -- the vocabulary ------------------------------------------------------------------


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, at_least: int = 2, change=None) -> DataFrame:
    """``(word, n)``: runs of letters of whole texts, ASCII letters lower-cased, with their number in all texts.

    Only words of ``shortest`` characters and ``at_least`` occurrences.  ``change``
    (doc_id, word) -> word may rewrite an occurrence first (it must not make it
    longer).  A null text has none; ids may be null or repeat; an empty table
    gives an empty result; a run of any length is one word.
    """
    text = F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower())
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"),
                        F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("word"))
    if change is not None:
        found = found.select(change(F.col("doc_id"), F.col("word")).alias("word")).where(F.length("word") >= shortest)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def _route(words: DataFrame, block: int) -> DataFrame:
    """``(key, s, n, back, indexed)``: each word, read from either end, to every group it must ask; indexed in one."""
    s = F.col("s")
    sides = words.select("n", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("s")),
                                                F.struct(F.lit(True).alias("back"), F.reverse("word").alias("s")))).alias("x")).select("n", "x.*")
    rows = sides.withColumn("key", F.when(F.col("back"), F.substring(s, 1, ROUTE[1])).otherwise(F.substring(s, 1, ROUTE[0])))
    big = rows.groupBy("back", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    rows = rows.join(big.select("back", "key", F.lit(True).alias("hot")), ["back", "key"], "left")
    cool = rows.where(F.col("hot").isNull()).select("key", "s", "n", "back", F.lit(True).alias("indexed"))
    # words of length L agree with near ones in their first (L - 1) // 2 characters at least
    long = F.length(s)
    asks = [F.struct((long + d).alias("of"), F.floor((long + d - 1) / 2).cast("int").alias("part"), F.lit(d == 0).alias("indexed")) for d in (-1, 0, 1)]
    fine = (rows.where("hot").select("s", "n", "back", F.explode(F.array(*asks)).alias("a"))
            .select("s", "n", "back", "a.indexed", F.concat_ws(" ", "a.of", s.substr(F.lit(1), F.col("a.part"))).alias("key")))
    blocks = (fine.where("indexed").groupBy("back", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    fine = fine.join(blocks, ["back", "key"])  # a group without words answers nothing
    own = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    spread = (fine.select("key", "s", "n", "back", "indexed", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
              .select(F.concat_ws(" ", "key", "b").alias("key"), "s", "n", "back", (F.col("indexed") & (F.col("b") == F.col("own"))).alias("indexed")))
    return cool.unionByName(spread)


def near_words(words: DataFrame, block: int = 50_000) -> DataFrame:
    """``(word, near, near_n)``: all ordered pairs of ``words`` (word, n) exactly one edit apart, each once.

    An edit inserts, deletes or replaces one code point.  Words are distinct, not
    null, of at least ``SHORTEST`` code points.  A task indexes about ``block`` words.
    """
    rows = keep(_route(words, block))
    tasks = max(partitions(words), -(-rows.where("indexed").count() // block))
    return rows.repartition(tasks, "back", "key").mapInArrow(_search, "word string, near string, near_n long")


def spelling_forms(words: DataFrame, times: int = 10, block: int = 50_000) -> DataFrame:
    """Each word of ``words`` (word, n) with ``form``, ``root``, ``n_near`` and ``form_n``.

    ``form``: the near word of largest n (ties: smallest in code-point order) if
    that is at least ``times`` the word's; ``root``: where following forms ends.
    Words without a form are their own root; an empty table gives an empty result.
    """
    if times < 2 or block < 1:
        raise ValueError("times must be at least 2 and block positive")
    words = keep(words)
    near = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("top"))
    named = words.join(near, "word", "left").withColumn("ok", F.coalesce(-F.col("top.n") >= times * F.col("n"), F.lit(False)))
    named = keep(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(F.col("ok"), F.col("top.w")).alias("form"), F.when(F.col("ok"), -F.col("top.n")).alias("form_n")))
    # counts grow by ``times`` a step, so chains are short: their longest possible length gives the rounds
    span = words.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = int(math.log(span["most"] / span["least"], times) + 1e-9) if span["most"] else 0
    jump = named.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    for _ in range(max(0, steps - 1).bit_length()):
        onward = jump.select(F.col("word").alias("to"), F.col("to").alias("next"))
        after = keep(jump.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to")))
        discard(jump)
        jump = after
    return named.join(jump, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(doc_id: Column, word: Column) -> Column:
    """The occurrence as it counts: where 31 divides the CRC-32 of id and word, one code point is left out (null id: empty)."""
    h = F.crc32(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 31 == 0, F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))).otherwise(word)


def query(spark, sf_dir: str) -> DataFrame:
    words = vocabulary(read(spark, sf_dir, "documents").select("doc_id", "text"), change=misspelt)
    return spelling_forms(words)
