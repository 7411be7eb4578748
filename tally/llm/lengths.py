"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are encoded once and reduced to (length, documents), combined before
the shuffle.  Suffix sums over lengths then answer totals, quantiles and
truncated totals for every context limit without looking at a document again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.llm.common import keep, read

#: Vocabulary file read by default; any file of ranks in the same format will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits a text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blank runs of this many characters are taken out of the pattern's engine; the result doesn't depend on it.
LONG_BLANK = 10_000
_BLANKS = regex.compile(r"\p{White_Space}{%d,}" % LONG_BLANK)
_ENCODERS: dict[int, tiktoken.Encoding] = {}


def encoder(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoder of a ranks file's content, made once in each process."""
    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def _cuts(text: str) -> Iterator[tuple[str, bool]]:
    """The text cut around long blank runs: (part, whether it is one match of the pattern).

    Of a blank run before something else all but the last character are one
    match, the whole run at the end of the text; the tokenizer's own engine would
    recurse once a character of it.
    """
    at = 0
    for m in _BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        yield text[at:m.start()], False
        yield text[m.start():end], True
        at = end
    yield text[at:], False


def count_tokens(enc: tiktoken.Encoding, text: str | None) -> int:
    """Number of tokens of a text of any length (null: none)."""
    if not text:
        return 0
    if len(text) < LONG_BLANK:
        return len(enc.encode_ordinary(text))
    return sum(len(enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)) for part, whole in _cuts(text) if part)


def _lengths(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for b in batches:
            n = [count_tokens(enc, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])
    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row; null and empty texts have none.

    Texts of any length are counted whole; ids may be null or repeat, an empty
    table gives an empty result, and other columns are not looked at.  The driver reads the vocabulary file (about 1 MB) and sends its content along.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_lengths(ranks, pattern), "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """``(n_tokens, docs)``: how many rows have each length (an empty table has none; repeated and null ids count as rows)."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """The histogram with ``docs_at_least``, ``tokens_at_least``, ``truncated_total`` and ``share_at_most``.

    ``truncated_total``: tokens left if every text is cut to ``n_tokens``.  Sums run
    in two levels, over blocks of ``block`` lengths and then in each block, so
    no task sees more than the blocks or one block.  An empty histogram gives
    an empty result.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    above = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_above"),
                          F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_above"),
                          F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = (h.join(above, "block")
         .withColumn("docs_at_least", F.sum("docs").over(here) + F.col("d_above"))
         .withColumn("tokens_at_least", F.sum("tokens").over(here) + F.col("t_above")))
    return s.select("n_tokens", "docs", "docs_at_least", "tokens_at_least",
                    (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
                    ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("share_at_most"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(context, docs_over, truncated_total, total)`` for any context limits, from the suffix sums alone."""
    limits = sorted({int(x) for x in limits})
    if not limits:
        return sums.sparkSession.createDataFrame([], "context long, docs_over long, truncated_total long, total long")
    # every limit is answered by the smallest length above it
    row = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
    picks = [F.min(F.when(F.col("n_tokens") > x, row)).alias(f"c{i}") for i, x in enumerate(limits)]
    def answer(i: int, x: int):
        context = F.lit(x).cast("long")
        docs, tokens = (F.coalesce(F.col(f"c{i}.{c}"), F.lit(0).cast("long")) for c in ("docs_at_least", "tokens_at_least"))
        return F.struct(context.alias("context"), docs.alias("docs_over"), (F.col("total") - tokens + context * docs).alias("truncated_total"), F.col("total").alias("total"))
    total = F.coalesce(F.max("tokens_at_least"), F.lit(0).cast("long")).alias("total")
    return sums.agg(total, *picks).select(F.inline(F.array(*[answer(i, x) for i, x in enumerate(limits)])))


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """``(q, n_tokens)``: the smallest length that at least a share ``q`` of documents does not exceed."""
    picks = [F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(qs)]
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(qs)])
    return sums.agg(*picks).select(F.inline(pairs))


def query(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return suffix_sums(keep(length_histogram(counts)))
