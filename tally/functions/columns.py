"""Name-level projections (P1, P2, P6) as ``DataFrame -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame

__all__ = ["lower_names", "rename_columns", "drop_suffix", "drop_columns"]


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename columns, including names with special characters."""
    return df.withColumnsRenamed(mapping)


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Drop every column whose name ends with ``suffix`` (case-insensitive)."""
    s = suffix.lower()
    return df.drop(*[c for c in df.columns if c.lower().endswith(s)])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """P5: drop named columns."""
    return df.drop(*names)
