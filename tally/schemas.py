"""Explicit schemas of every table the engine reads or writes.

Nothing is inferred: a line name such as ``7`` must stay a string so the
string joins on station and line name keep working.
"""

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()
TS = T.TimestampNTZType()

# Weekly readings file: eleven positional columns, read as text and parsed in
# expressions so that malformed cells become null instead of failing the scan.
READINGS_COLUMNS = ["c/a", "unit", "scp", "station", "linename", "division",
                    "date", "time", "desc", "entries", "exits"]
READINGS_RAW = T.StructType([T.StructField(c, S) for c in READINGS_COLUMNS])

# Cleaned readings (output of D1).
READINGS = T.StructType([
    T.StructField("id", S), T.StructField("datetime", TS),
    T.StructField("station", S), T.StructField("linename", S),
    T.StructField("entries", D),
])

SNAPSHOT = T.StructType([
    T.StructField("id", S), T.StructField("datetime", TS), T.StructField("entries", D),
    T.StructField("station", S), T.StructField("linename", S),
])

WEEKLY = T.StructType([
    T.StructField("linename", S), T.StructField("station", S),
    T.StructField("weekdate", TS), T.StructField("week", T.IntegerType()),
    T.StructField("weekend", D), T.StructField("weekday_am", D), T.StructField("weekday_pm", D),
])

STATIONS = T.StructType([
    T.StructField("station", S), T.StructField("linename", S),
    T.StructField("station_new", S), T.StructField("linename_new", S),
])

BASELINE = T.StructType([
    T.StructField("linename", S), T.StructField("station", S), T.StructField("week", T.IntegerType()),
    T.StructField("weekend", D), T.StructField("weekday_am", D), T.StructField("weekday_pm", D),
])

WEEKLY_KEYS = ["linename", "station", "weekdate", "week"]
BASELINE_KEYS = ["linename", "station", "week"]
STATION_KEYS = ["linename", "station"]
