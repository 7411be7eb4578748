"""Published versions, manifests and parts of the accumulated table: crashes, late files, touched weeks."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.operators.weekly import merge_weekly
from tally.plans.backfill import LateFiles, backfill, is_done
from tally.plans.e2e import WEEK1, WEEK2
from tally.schemas import SNAPSHOT, WEEKLY
from tally.sources.manifest import changes, input_files
from tally.sources.store import Store
from tally.streaming import start_weekly_stream
from tests.test_streaming import CFG, _land, _rows, _tiny

WEEK3 = WEEK2 + dt.timedelta(days=7)


def _frame(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "x long")


def _count(spark, st, table="t", day=WEEK1):
    return st.read(spark, table, day).count()


def test_a_crash_at_any_step_leaves_a_whole_version(spark, monkeypatch):
    st = Store(tempfile.mkdtemp(prefix="tally-store-"))
    assert not st.exists(spark, "t", WEEK1)
    with pytest.raises(FileNotFoundError):
        st.read(spark, "t", WEEK1)
    st.write(_frame(spark, 3), "t", WEEK1)
    first = st.version(spark, "t", WEEK1)

    def lost(*a, **k):
        raise RuntimeError("lost")
    # while the data is written: half a folder lies there, no commit names it
    bad = _frame(spark, 5).select(F.when(F.col("x") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("long").alias("x")).repartition(3)
    with pytest.raises(Exception, match="lost"):
        st.write(bad, "t", WEEK1)
    assert _count(spark, st) == 3 and st.version(spark, "t", WEEK1) == first
    # after the data, before the commit
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lost)
        with pytest.raises(RuntimeError):
            st.write(_frame(spark, 5), "t", WEEK1)
    assert _count(spark, st) == 3
    # while the commit file is written: every torn length of it is passed over
    folder = st._folder("t", WEEK1)
    with open(f"{folder}/_commit-00000001", "rb") as f:
        whole = f.read()
    for i, cut in enumerate((0, 1, 8, 9, 20, len(whole) - 1)):
        with open(f"{folder}/_commit-{i + 2:08d}", "wb") as f:
            f.write(whole[:cut])
        assert _count(spark, st) == 3
    # the next run publishes after the torn ones
    st.write(_frame(spark, 7), "t", WEEK1)
    assert _count(spark, st) == 7 and st.version(spark, "t", WEEK1) != first
    # nothing was deleted or renamed; vacuum takes what no commit names
    assert spark.read.parquet(f"{folder}/{first}").count() == 3
    assert st.vacuum(spark, "t") == []
    gone = st.vacuum(spark, "t", older_than_hours=0)
    assert len(gone) >= 2 and f"run_date={WEEK1}/{first}" in gone and _count(spark, st) == 7
    st.drop(spark, "t", WEEK1)
    assert not st.exists(spark, "t", WEEK1) and st.dates(spark, "t") == []


def test_csv_exports_are_published_too(spark, monkeypatch):
    st = Store(tempfile.mkdtemp(prefix="tally-store-"))
    schema = _frame(spark, 1).schema
    st.export_csv(_frame(spark, 3), "c", WEEK1)

    def lost(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lost)
        with pytest.raises(RuntimeError):
            st.export_csv(_frame(spark, 5), "c", WEEK1)
    assert st.read_csv(spark, "c", WEEK1, schema).count() == 3
    st.export_csv(_frame(spark, 5), "c", WEEK1)
    assert st.read_csv(spark, "c", WEEK1, schema).count() == 5


def _cells(spark, rows):
    return spark.createDataFrame([("L", s, d, 1 + (d.timetuple().tm_yday - 1) // 7 if d else None, *v) for s, d, *v in rows], WEEKLY)


def test_merge_reads_and_writes_touched_weeks_only(spark):
    from tally.plans.week import merge_touched_weeks
    st = Store(tempfile.mkdtemp(prefix="tally-parts-"))
    monday = [dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(6)]
    old = _cells(spark, [(f"S{j}", m, float(i), None, float(j)) for i, m in enumerate(monday[:5]) for j in range(3)] + [("S9", None, 1.0, 2.0, 3.0)])
    new = _cells(spark, [("S0", monday[3], None, 7.0, 8.0), ("S7", monday[3], 1.0, None, None), ("S1", monday[5], 5.0, 5.0, None)])
    cfg = RunConfig(run_date=WEEK2)
    st.write(old, "weekly", WEEK1)
    before = st.entry(spark, "weekly", WEEK1)["parts"]
    assert len(before) == 6
    got = merge_touched_weeks(spark, st, new, old, cfg)
    assert _rows(got) == _rows(merge_weekly(new, old).select(*got.columns))
    after = st.entry(spark, "weekly", WEEK2)["parts"]
    own = {k for k in after if after[k] != before.get(k)}
    assert own == {"2024-01-22", "2024-02-05"} and set(after) == set(before) | own
    # one folder a touched week was written, and only the touched old week is in the plan that read it
    written = os.listdir(st.path("weekly", WEEK2))
    assert sorted(n for n in written if n.startswith("part=")) == sorted(f"part={k}" for k in own)
    read = st.read(spark, "weekly", WEEK1, WEEKLY, parts=["2024-01-22", "2024-02-05"])
    assert [f for f in read.inputFiles() if "part=2024-01-22" not in f] == [] and read.count() == 3
    # a run without cells keeps every part; a store without a prior version takes the table given
    assert _rows(merge_touched_weeks(spark, st, new.limit(0), old, cfg.with_(run_date=WEEK3))) == _rows(got)
    other = Store(tempfile.mkdtemp(prefix="tally-parts-"))
    assert _rows(merge_touched_weeks(spark, other, new, old, cfg)) == _rows(got)
    # an unneeded old version goes, the parts that later versions name stay
    st.vacuum(spark, "weekly", older_than_hours=0)
    assert _rows(st.read(spark, "weekly", WEEK2, WEEKLY)) == _rows(got)


def test_manifest_lists_files(spark):
    root = tempfile.mkdtemp(prefix="tally-files-")
    a = _land(f"{root}/x", "readings_240113.txt", WEEK1, "U1")
    _land(f"{root}/x/folder_240114", "part-0.csv", WEEK1, "U1")
    open(f"{root}/x/folder_240114/_SUCCESS", "w").close()
    one = input_files(spark, f"{root}/x")
    assert [os.path.basename(f[0]) for f in one] == ["part-0.csv", "readings_240113.txt"] and all(f[1] > 0 and f[2] > 0 for f in one)
    assert input_files(spark, [a, f"{root}/x/*", f"{root}/none"]) == one and changes(one, one) == {}
    b = [[f[0], f[1] + 1, f[2]] for f in one[:1]] + [["z", 1, 1]]
    assert changes(one, b) == {"new": ["z"], "changed": [one[0][0]], "gone": [one[1][0]]}


def _three_weeks(spark):
    root = tempfile.mkdtemp(prefix="tally-late-")
    st, stations, base = _tiny(spark, root)
    files = {w: _land(f"{root}/landing", f"readings_{w:%y%m%d}.txt", w, "U1", n=6 + i) for i, w in enumerate((WEEK1, WEEK2, WEEK3))}
    return root, st, stations, base, files


def test_a_late_file_runs_its_week_and_all_later_ones_again(spark):
    root, st, stations, base, files = _three_weeks(spark)
    assert backfill(spark, st, files, stations, base, CFG) == [WEEK1, WEEK2, WEEK3]
    assert backfill(spark, st, files, stations, base, CFG) == []
    late = _land(f"{root}/landing", f"correction_{WEEK2 + dt.timedelta(days=3):%y%m%d}.txt", WEEK2, "U2", n=9)
    day = WEEK2 + dt.timedelta(days=3)
    with pytest.raises(LateFiles, match="correction_240123"):
        backfill(spark, st, {day: late}, stations, base, CFG, late="refuse")
    one = st.version(spark, "snapshots", WEEK1)
    # only the late file is given: the week reads it with the files of its own manifest
    assert backfill(spark, st, {day: late}, stations, base, CFG) == [WEEK2, WEEK3]
    assert st.version(spark, "snapshots", WEEK1) == one
    assert {r.id for r in st.read(spark, "snapshots", WEEK3, SNAPSHOT).collect()} == {"A_U1_0", "A_U2_0"}
    assert backfill(spark, st, files | {day: late}, stations, base, CFG) == []
    # the same files in one go give the same state
    st2, stations, base = _tiny(spark, f"{root}/again")
    both = {WEEK1: files[WEEK1], WEEK2: [files[WEEK2], late], WEEK3: files[WEEK3]}
    assert backfill(spark, st2, both, stations, base, CFG) == [WEEK1, WEEK2, WEEK3]
    for t, schema in (("weekly", WEEKLY), ("snapshots", SNAPSHOT)):
        assert _rows(st.read(spark, t, WEEK3, schema)) == _rows(st2.read(spark, t, WEEK3, schema))
    # a changed file counts like a new one, a vanished one is named
    _land(f"{root}/landing", f"readings_{WEEK3:%y%m%d}.txt", WEEK3, "U1", n=10)
    assert backfill(spark, st, files, stations, base, CFG) == [WEEK3]
    os.remove(files[WEEK2])
    with pytest.raises(LateFiles, match="readings_240120"):
        backfill(spark, st, {WEEK3: files[WEEK3]} | {day: _land(f"{root}/landing", f"more_{day:%y%m%d}.txt", WEEK2, "U3")}, stations, base, CFG)


def test_a_crash_between_re_runs_is_made_up_for(spark, monkeypatch):
    """A week re-run without its successor: the next backfill sees that the successor started from the old state."""
    import tally.plans.backfill as bf
    root, st, stations, base, files = _three_weeks(spark)
    backfill(spark, st, files, stations, base, CFG)
    late = _land(f"{root}/landing", f"late_{WEEK1:%y%m%d}.txt", WEEK1, "U2")
    run, seen = bf.run_landed_week, []

    def once(*a, **k):
        if seen:
            raise RuntimeError("lost")
        seen.append(a)
        return run(*a, **k)
    with monkeypatch.context() as m:
        m.setattr(bf, "run_landed_week", once)
        with pytest.raises(RuntimeError):
            backfill(spark, st, {WEEK1: late}, stations, base, CFG)
    assert is_done(spark, st, WEEK2, CFG)
    # even if only the newest week is asked for
    assert backfill(spark, st, {WEEK3: files[WEEK3]}, stations, base, CFG) == [WEEK2, WEEK3]
    assert backfill(spark, st, files, stations, base, CFG) == []
    assert {r.id for r in st.read(spark, "snapshots", WEEK3, SNAPSHOT).collect()} == {"A_U1_0", "A_U2_0"}


def test_the_stream_refuses_or_re_runs_late_files(spark):
    root, st, stations, base, files = _three_weeks(spark)
    start_weekly_stream(spark, f"{root}/landing", st, f"{root}/ckpt", stations, base, CFG).awaitTermination()
    assert st.dates(spark, "runs") == [WEEK1, WEEK2, WEEK3]
    _land(f"{root}/landing", f"late_{WEEK2:%y%m%d}.txt", WEEK2, "U2")
    q = start_weekly_stream(spark, f"{root}/landing", st, f"{root}/ckpt", stations, base, CFG)
    with pytest.raises(Exception, match="late_240120"):
        q.awaitTermination()
    assert {r.id for r in st.read(spark, "snapshots", WEEK3, SNAPSHOT).collect()} == {"A_U1_0"}
    start_weekly_stream(spark, f"{root}/landing", st, f"{root}/ckpt", stations, base, CFG, late="rerun").awaitTermination()
    assert {r.id for r in st.read(spark, "snapshots", WEEK3, SNAPSHOT).collect()} == {"A_U1_0", "A_U2_0"}
