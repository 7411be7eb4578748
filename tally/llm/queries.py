"""Queries of this package for ``__spark_entry__``: ``(spark, sf_dir) -> DataFrame`` and DuckDB SQL."""

from __future__ import annotations

from tally.llm import decontam, langid, lengths, licenses, lm, mixing, oracle, pieces, quality, runs, shards, simhash, spelling, suffix
from tally.session import size_shuffles

#: Arrow batches of whole texts stay small, whatever their length.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def apply_settings(spark, sf_dir: str) -> None:
    """Batch size, and shuffle partitions of 256 MB of the documents each where the session has fewer."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    size_shuffles(spark, f"{sf_dir}/documents.parquet")


def _with_settings(fn):
    def run(spark, sf_dir):
        apply_settings(spark, sf_dir)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__module__.rpartition(".")[2], fn.__doc__
    return run


_ALL = {
    "op1_decontaminate": decontam.query,
    "op2_pieces": pieces.query,
    "op3_quality": quality.query,
    "op4_licenses": licenses.query,
    "op5_backoff": lm.query,
    "op6_simhash": simhash.query,
    "op7_langid": langid.query,
    "op8_suffix_dedup": suffix.query,
    "op9_shards": shards.query,
    "op10_lengths": lengths.query,
    "op11_mixing": mixing.query,
    "op12_runs": runs.query,
    "op13_spelling": spelling.query,
}

QUERIES = {k: _with_settings(f) for k, f in _ALL.items()}
ORACLE = {
    "op3_quality": quality.SQL,
    "op4_licenses": oracle.LICENSES,
    "op5_backoff": oracle.BACKOFF,
    "op8_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op12_runs": oracle.RUNS,
    "op13_spelling": oracle.SPELLING,
}
