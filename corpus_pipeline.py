"""From raw documents to piece ids: five stages, each one operator of ``tally.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows the one before
kept.  All but the last return the columns of ``documents``; nulls, empty and
repeated rows are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.llm.common import keep, read
from tally.llm.decontam import drop_contaminated
from tally.llm.pieces import encode
from tally.llm.quality import keep_good
from tally.llm.queries import apply_settings
from tally.llm.simhash import simhash_keep_first
from tally.llm.suffix import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    apply_settings(spark, sf_dir)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates (four-word shingles, four bits) one document stays."""
    apply_settings(spark, sf_dir)
    return simhash_keep_first(docs, shingle=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that starts elsewhere too go; ``n_chars`` follows."""
    apply_settings(spark, sf_dir)
    return drop_repeats(docs, length=200)


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    apply_settings(spark, sf_dir)
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` with the piece ids of its best segmentation, the scores of the best four, and the round trip."""
    apply_settings(spark, sf_dir)
    return encode(docs, n=4, columns=["doc_id"]).select("row.doc_id", "n_pieces", "ids", "nbest_scores", "nbest_crc32", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_overlap),
    ("piece encoding", piece_ids),
]

#: SimHash components, suffix arrays and segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
    return docs
