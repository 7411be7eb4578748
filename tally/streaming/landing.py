"""Run the weekly job whenever a readings file lands.

The reference is a batch script run once a week on the newest file
(``readings_yymmdd.txt``).  Here a Structured Streaming file source watches the
landing folder, and ``foreachBatch`` runs the weekly job for every Saturday
week that has new files, oldest first, on *all* landed files of that week: part
files and corrections of one week are one run.  The weekly job replaces its own
versions, so a restart after a failure neither skips nor double-counts a week.
A file for a week whose successor has already run is refused by name, since the
later weeks were built on the state without it, or makes them all run again
(``late="rerun"``).  There is no
streaming state: the carried state lives in the store, as in the reference.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tally.config import RunConfig
from tally.plans.backfill import backfill, by_week
from tally.schemas import READINGS_RAW
from tally.sources.store import Store

__all__ = ["file_date_of", "landed_files", "start_weekly_stream"]

_TAG = re.compile(r"(\d{6})(?:\.[A-Za-z]+)?$")


def file_date_of(path: str) -> dt.date:
    """File date from a ``..._yymmdd.txt`` file name (the public naming)."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    m = _TAG.search(name)
    if not m:
        raise ValueError(f"no yymmdd date in file name {name!r}")
    return dt.datetime.strptime(m.group(1), "%y%m%d").date()


def landed_files(spark: SparkSession, landing_dir: str) -> list[tuple[dt.date, str]]:
    """``(file date, path)`` of every readings file in a landing folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(landing_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [st.getPath().toString() for st in fs.listStatus(root)]
    return [(file_date_of(p), p) for p in paths if not p.rsplit("/", 1)[-1].startswith(("_", "."))]


def start_weekly_stream(spark: SparkSession, landing_dir: str, store: Store, checkpoint: str,
                        stations: DataFrame, baseline: DataFrame, cfg: RunConfig = RunConfig(),
                        available_now: bool = True, late: str = "refuse") -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what has landed and stops.

    ``late="rerun"`` runs a week that got a late file, and all later ones, again instead of refusing it.
    """
    src = (spark.readStream.schema(READINGS_RAW)
           .option("header", True).option("enforceSchema", True).option("escape", '"')
           .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
           .csv(landing_dir)
           .select("*", F.col("_metadata.file_path").alias("__file")))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        new = [r["__file"] for r in batch.select("__file").distinct().collect()]
        landed = by_week(landed_files(spark, landing_dir))
        touched = sorted(by_week([(file_date_of(f), f) for f in new]))
        for week in touched[:1]:
            c = cfg.with_(run_date=week)
            if not (store.exists(spark, "snapshots", c.prior_date())
                    and store.exists(spark, "weekly", c.prior_date())):
                raise RuntimeError(f"state for {c.prior_date()} is missing; land files in date order")
        backfill(spark, store, {week: landed[week] for week in touched}, stations, baseline, cfg, late=late)

    q = (src.writeStream.foreachBatch(run_batch)
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 hour")
    return q.start()
