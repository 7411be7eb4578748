import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tally.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", 8, app_name="tally-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def ts(day, hour=0, minute=0, second=0, month=1, year=2024):
    return dt.datetime(year, month, day, hour, minute, second)


READ_SCHEMA = "id string, datetime timestamp_ntz, entries double"
SNAP_SCHEMA = "id string, datetime timestamp_ntz, entries double, station string, linename string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def hourly(id_, values, start=None, step_h=1, station="S", line="L"):
    """Readings of one counter at ``step_h`` hour steps."""
    start = start or ts(8, 8)
    return [(id_, start + dt.timedelta(hours=step_h * i), float(v) if v is not None else None)
            for i, v in enumerate(values)]
