"""The readings file reader and its traps."""

import datetime as dt
import os
import tempfile

from tally.sources import read_readings

HEADER = "C/A,UNIT,SCP,STATION,LINENAME,DIVISION,DATE,TIME,DESC,ENTRIES,EXITS                 \n"


def test_t8_reader(spark):
    body = (
        "A002,R051,02-00-00,59 ST,NQR456W,BMT,05/01/2022,00:00:00,REGULAR,0007,1\n"
        " A002 , R051 ,02-00-01, 59 ST ,NQR456W,BMT,5/1/2022,4:00:00,REGULAR, 12 ,1\n"
        "A002,NA,02-00-02,59 ST,NQR456W,BMT,05/01/2022,00:00:00,REGULAR,5,1\n"
        "A002,R051,02-00-03,59 ST,NQR456W,BMT,garbage,00:00:00,REGULAR,x,1\n"
        "A002,R051,02-00-04,59 ST,NQR456W,PTH,05/01/2022,00:00:00,REGULAR,5,1\n"
        "A002,R051,02-00-05,59 ST,7,,05/01/2022,00:00:00,REGULAR,NaN,1\n"
        "\"A,3\",R051,02-00-06,\"59 ST, X\",7,RIT,05/01/2022,00:00:00,REGULAR,5,1\n"
    )
    d = tempfile.mkdtemp(prefix="tally-test-")
    with open(os.path.join(d, "readings_220507.txt"), "w") as f:
        f.write(HEADER + body)
    df = read_readings(spark, d)
    assert df.columns == ["id", "datetime", "station", "linename", "entries"]
    rows = sorted((tuple(r) for r in df.collect()), key=str)
    assert rows == sorted([
        ("A002_R051_02-00-00", dt.datetime(2022, 5, 1), "59 ST", "NQR456W", 7.0),
        ("A002_R051_02-00-01", dt.datetime(2022, 5, 1, 4), "59 ST", "NQR456W", 12.0),
        (None, dt.datetime(2022, 5, 1), "59 ST", "NQR456W", 5.0),
        ("A002_R051_02-00-03", None, "59 ST", "NQR456W", None),
        ("A002_R051_02-00-05", dt.datetime(2022, 5, 1), "59 ST", "7", None),
    ], key=str)


def test_u3_many_files_one_scan(spark):
    d = tempfile.mkdtemp(prefix="tally-test-")
    for i, day in enumerate(("05/01/2022", "05/08/2022")):
        with open(os.path.join(d, f"readings_22050{i}.txt"), "w") as f:
            f.write(HEADER + f"A002,R051,02-00-00,59 ST,NQR456W,BMT,{day},00:00:00,REGULAR,{i + 1},1\n")
    paths = [os.path.join(d, n) for n in sorted(os.listdir(d))]
    df = read_readings(spark, paths)
    assert sorted(r.entries for r in df.collect()) == [1.0, 2.0]
