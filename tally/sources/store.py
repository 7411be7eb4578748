"""Versioned state tables.

Each run writes its outputs as a new version of ``<root>/<table>/run_date=<d>``
and reads the previous run's version, so a run never overwrites what it
reads, and re-running a week replaces only that week's version.  The root is a
shared (cluster-visible) folder.

A version is written under a fresh name and then published by one small commit
file, which names it.  Commit files are numbered; the last whole one counts (a torn
one fails its checksum and is passed over), so a crash at any step leaves the
old version readable or the new one.  Nothing is deleted, renamed or overwritten:
on an object store publishing is one small ``PUT``.  ``vacuum`` removes what no
commit names any more, when the user asks for it.

The accumulated table is kept in parts by Monday week.  A version lists its parts,
and a run that touches some weeks writes only those; the others are named as they are.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["Store", "read_table", "PARTS"]

#: Tables kept in parts, and the column whose day names a row's part.
PARTS = {"weekly": "weekdate"}
_NO_DAY = "none"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read a table with an explicit schema (CSV) or its own (Parquet).

    CSV columns are found by their header names (white space around them and
    around cells is trimmed, ``NA`` and empty cells are missing): those of
    ``schema`` are cast, in any order of the file, others stay as text.  A
    column of ``schema`` that the file lacks is an error.
    """
    if fmt == "csv":
        raw = (spark.read.option("header", True).option("escape", '"')
               .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
        raw = raw.toDF(*[c.strip() for c in raw.columns])
        known = {f.name: f.dataType for f in (schema or [])}
        missing = sorted(set(known) - set(raw.columns))
        if missing:
            raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
        def cell(c):
            text = F.trim(F.col(f"`{c}`"))
            text = F.when(~text.isin("", "NA"), text)
            return (text.try_cast(known[c]) if c in known else text).alias(c)
        return raw.select(*[cell(c) for c in [*known, *[c for c in raw.columns if c not in known]]])
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


class Store:
    """Tables under one root, one folder per run date, versions named by commit files."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    # -- commits ------------------------------------------------------------------

    def _folder(self, table: str, run_date: dt.date) -> str:
        return f"{self.root}/{table}/run_date={run_date.isoformat()}"

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, spark: SparkSession, folder: str, prefix: str) -> list[str]:
        fs, p = self._fs(spark, folder)
        if not fs.exists(p):
            return []
        return sorted(n for n in (st.getPath().getName() for st in fs.listStatus(p)) if n.startswith(prefix))

    def commit(self, spark: SparkSession, table: str, run_date: dt.date, entry: dict) -> None:
        """Publish ``entry`` as the state of a version: one new file, never written over."""
        folder = self._folder(table, run_date)
        text = json.dumps(entry, sort_keys=True)
        data = f"{zlib.crc32(text.encode()):08x} {text}".encode()
        number = max((int(n[8:]) for n in self._names(spark, folder, "_commit-")), default=0) + 1
        fs, p = self._fs(spark, f"{folder}/_commit-{number:08d}")
        out = fs.create(p, False)
        try:
            out.write(data)
        finally:
            out.close()

    def entry(self, spark: SparkSession, table: str, run_date: dt.date) -> dict | None:
        """The last whole commit of a version; None if there is none or it was dropped."""
        folder = self._folder(table, run_date)
        for name in reversed(self._names(spark, folder, "_commit-")):
            fs, p = self._fs(spark, f"{folder}/{name}")
            stream = fs.open(p)
            try:
                data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            check, _, text = data.partition(" ")
            if check == f"{zlib.crc32(text.encode()):08x}":
                entry = json.loads(text)
                return None if entry.get("dropped") else entry
        return None

    def exists(self, spark: SparkSession, table: str, run_date: dt.date) -> bool:
        """True if the version was published."""
        return self.entry(spark, table, run_date) is not None

    def version(self, spark: SparkSession, table: str, run_date: dt.date) -> str | None:
        """The name of the published version; a new run of its week gives it a new one."""
        e = self.entry(spark, table, run_date)
        return e["version"] if e else None

    def dates(self, spark: SparkSession, table: str) -> list[dt.date]:
        """Run dates of the published versions of a table, oldest first."""
        days = [dt.date.fromisoformat(n[9:]) for n in self._names(spark, f"{self.root}/{table}", "run_date=")]
        return [d for d in days if self.exists(spark, table, d)]

    def path(self, table: str, run_date: dt.date) -> str:
        """The published version's folder (of a table in parts: the folder of those the last run wrote)."""
        spark = SparkSession.getActiveSession()
        e = self.entry(spark, table, run_date) if spark else None
        if e is None:
            raise FileNotFoundError(f"{self._folder(table, run_date)} has no published version")
        return f"{self._folder(table, run_date)}/{e['version']}"

    def drop(self, spark: SparkSession, table: str, run_date: dt.date) -> None:
        """Unpublish a version that a new run of its week doesn't make any more."""
        if self.exists(spark, table, run_date):
            self.commit(spark, table, run_date, {"dropped": True})

    def vacuum(self, spark: SparkSession, table: str, older_than_hours: float = 24 * 7) -> list[str]:
        """Delete the version folders of a table that no published version names, if they are old enough; returns them.

        Runs that are still going may be writing the young ones, so keep the age above a run's length.
        """
        used, gone = set(), []
        for d in self.dates(spark, table):
            e = self.entry(spark, table, d)
            used.add(f"run_date={d.isoformat()}/{e['version']}")
            used |= {p.rsplit("/", 1)[0] for p in e.get("parts", {}).values()}
        limit = (time.time() - older_than_hours * 3600) * 1000
        for day in self._names(spark, f"{self.root}/{table}", "run_date="):
            for name in self._names(spark, f"{self.root}/{table}/{day}", "v-"):
                fs, p = self._fs(spark, f"{self.root}/{table}/{day}/{name}")
                if f"{day}/{name}" not in used and fs.getFileStatus(p).getModificationTime() <= limit:
                    fs.delete(p, True)
                    gone.append(f"{day}/{name}")
        return gone

    # -- tables -------------------------------------------------------------------

    def read(self, spark: SparkSession, table: str, run_date: dt.date,
             schema: T.StructType | None = None, parts: list[str] | None = None) -> DataFrame:
        """A published version; of a table in parts all of them, or only ``parts``: no other is listed or read."""
        e = self.entry(spark, table, run_date)
        if e is None:
            raise FileNotFoundError(f"{self._folder(table, run_date)} has no published version")
        schema = schema or T.StructType.fromJson(e["schema"])
        if "parts" not in e:
            return read_table(spark, f"{self._folder(table, run_date)}/{e['version']}", schema)
        paths = [f"{self.root}/{table}/{p}" for k, p in sorted(e["parts"].items()) if parts is None or k in parts]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    @staticmethod
    def part_of(table: str):
        """The name of a row's part: the day of its ``PARTS`` column."""
        return F.coalesce(F.date_format(PARTS[table], "yyyy-MM-dd"), F.lit(_NO_DAY))

    def write(self, df: DataFrame, table: str, run_date: dt.date, onto: dict[str, str] | None = None) -> str:
        """Write a version under a fresh name, then publish it.

        Of a table in parts, ``onto`` names parts of an earlier version (its commit's ``parts``) that stay
        where ``df`` has none of its own.
        """
        spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
        p = f"{self._folder(table, run_date)}/{name}"
        entry = {"version": name, "schema": df.schema.jsonValue()}
        if table in PARTS:
            df.withColumn("part", self.part_of(table)).write.partitionBy("part").parquet(p)
            new = {n[5:]: f"run_date={run_date.isoformat()}/{name}/{n}" for n in self._names(spark, p, "part=")}
            entry["parts"] = (onto or {}) | new
        else:
            df.write.parquet(p)
        self.commit(spark, table, run_date, entry)
        return p

    def publish(self, spark: SparkSession, df: DataFrame, table: str, run_date: dt.date, onto: dict[str, str] | None = None) -> DataFrame:
        """K5: write, then continue from the written version so the plan runs once."""
        schema = df.schema
        self.write(df, table, run_date, onto)
        return self.read(spark, table, run_date, schema)

    def read_csv(self, spark: SparkSession, table: str, run_date: dt.date,
                 schema: T.StructType) -> DataFrame:
        return (spark.read.schema(schema).option("header", True).option("nullValue", "")
                .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'")
                .csv(self.path(table, run_date)))

    def export_csv(self, df: DataFrame, table: str, run_date: dt.date, null_value: str = "") -> str:
        """K2-K4: CSV hand-over; missing is ``null_value``, timestamps ISO 8601 with ``Z``.  Published like any version."""
        name = f"v-{uuid.uuid4().hex}"
        p = f"{self._folder(table, run_date)}/{name}"
        (df.write.option("header", True).option("nullValue", null_value)
         .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").csv(p))
        self.commit(df.sparkSession, table, run_date, {"version": name, "schema": df.schema.jsonValue()})
        return p
