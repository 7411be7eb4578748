"""Which files a run read (S1, S2): path, length and time of each, kept as run state.

A week's run is up to date if the files landed for it are the ones its manifest
names and its prior state is still the version it started from.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

__all__ = ["input_files", "changes"]


def input_files(spark: SparkSession, paths: list[str] | str) -> list[list]:
    """``[path, length, modification time]`` of every data file at ``paths`` (files, folders or globs), sorted by path.

    Listed on the driver, one entry a file; a path that matches nothing adds nothing.
    """
    found = {}
    for path in [paths] if isinstance(paths, str) else paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for top in fs.globStatus(p) or []:
            files = fs.listFiles(top.getPath(), True)
            while files.hasNext():
                f = files.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    found[f.getPath().toString()] = [f.getPath().toString(), f.getLen(), f.getModificationTime()]
    return [found[k] for k in sorted(found)]


def changes(before: list[list], now: list[list]) -> dict[str, list[str]]:
    """Paths that are new, changed or gone between two manifests."""
    a, b = ({f[0]: f[1:] for f in m} for m in (before, now))
    out = {"new": sorted(b.keys() - a.keys()), "changed": sorted(k for k in a.keys() & b.keys() if a[k] != b[k]), "gone": sorted(a.keys() - b.keys())}
    return {k: v for k, v in out.items() if v}
