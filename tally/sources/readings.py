"""Scan and clean a weekly readings file.

The file is read as text with the eleven positional columns, so the header's
spelling, case and padding do not matter (T8) and a malformed cell becomes
null in its own column rather than failing or blanking the row.  The scan is
narrow: no shuffle, and the division filter is evaluated right after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.functions.columns import lower_names, rename_columns
from tally.functions.exprs import clean_text, concat_strict, not_in_keep_null, parse_mdy_hms, to_double
from tally.schemas import READINGS, READINGS_RAW
from tally.sources.manifest import input_files

__all__ = ["PLACE", "scan_readings", "clean_readings", "read_readings", "read_landed", "observed"]

#: Where a reading stands: its file, the start of the split it was read in, and its number in the task's rows.
PLACE = "place"
_BAD = {"bad_datetime": "datetime", "bad_entries": "entries"}


def scan_readings(spark: SparkSession, path, place: bool = False) -> DataFrame:
    """The raw text columns of one or many landed files (a path, a list, a glob) in one scan.

    With ``place``, also where each row stands (O1, T1): rows of one file compare by
    the start of their split and, within it, by the order they were read in.
    """
    raw = (spark.read.schema(READINGS_RAW)
           .option("header", True).option("enforceSchema", True)
           .option("mode", "PERMISSIVE").option("escape", '"')
           .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
           .csv(path))
    if not place:
        return raw
    return raw.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                                    F.monotonically_increasing_id().alias("row")).alias(PLACE))


def clean_readings(raw: DataFrame, cfg: RunConfig = RunConfig(), more: tuple[str, ...] = (), flags: bool = False) -> DataFrame:
    """Lower-case names, ``c/a`` -> ``c_a``, drop excluded divisions,
    build ``id`` and ``datetime``.  Output ``id, datetime, station, linename, entries``,
    columns ``more`` of ``raw`` and, with ``flags``, which cells hold text that could not be parsed.
    """
    df = rename_columns(lower_names(raw), {"c/a": "c_a"})
    df = df.select(*[clean_text(c).alias(c) if c not in ("entries", "exits", *more) else F.col(c)
                     for c in df.columns])
    when = concat_strict("date", "time", sep=" ")
    bad = [(when.isNotNull() & parse_mdy_hms(when).isNull()).alias("bad_datetime"),
           (clean_text("entries").isNotNull() & clean_text("entries").try_cast("double").isNull()).alias("bad_entries")]
    return (df.where(not_in_keep_null("division", cfg.excluded_divisions))
            .select(concat_strict("c_a", "unit", "scp", sep="_").alias("id"),
                    parse_mdy_hms(when).alias("datetime"),
                    "station", "linename",
                    to_double("entries").alias("entries"), *more, *(bad if flags else [])))


def read_readings(spark: SparkSession, path, cfg: RunConfig = RunConfig(), flags: bool = False) -> DataFrame:
    """D1 = S1 + cleaning; with ``cfg.file_order`` the readings keep their ``place``."""
    more = (PLACE,) if cfg.file_order else ()
    return clean_readings(scan_readings(spark, path, cfg.file_order), cfg, more, flags)


def read_landed(spark: SparkSession, files: dict, cfg: RunConfig = RunConfig()) -> DataFrame:
    """D1 of the files of many weeks, ``{Saturday: path or paths}``, in one scan; column ``run`` is a file's Saturday.

    The driver holds the list of files.
    """
    runs = {f[0]: day for day, paths in sorted(files.items()) for f in input_files(spark, paths)}
    if not runs:
        return spark.createDataFrame([], READINGS).withColumn("run", F.lit(None).cast("date"))
    uri = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    spelt = ("^([A-Za-z0-9]+):/+", "$1:/")  # file:/a and file:///a are one path
    days = spark.createDataFrame([(uri(f).toUri().toString(), day) for f, day in sorted(runs.items())], "uri string, run date")
    days = days.select(F.regexp_replace("uri", *spelt).alias("file"), "run")
    rows = clean_readings(scan_readings(spark, sorted(runs), place=True), cfg, (PLACE,))
    rows = rows.withColumn("file", F.regexp_replace(f"{PLACE}.file", *spelt)).join(days, "file").drop("file")
    return rows if cfg.file_order else rows.drop(PLACE)


def observed(readings: DataFrame) -> tuple[DataFrame, Observation]:
    """The readings of ``read_readings(flags=True)`` and the counts by column of cells that could not be parsed.

    The counts come with the first action on the readings; there is no job of their own.
    """
    seen = Observation()
    counts = [F.coalesce(F.count_if(F.col(flag)), F.lit(0)).alias(column) for flag, column in _BAD.items()]
    return readings.observe(seen, *counts).drop(*_BAD), seen
