"""D2-D4 on hand-made counters (FIXTURES.md section 3) and chunked == plain windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tally.config import RunConfig
from tally.operators import clean_deltas, dominant_direction, latest_per_counter, raw_deltas
from tally.operators.chunked import seeded_lag, seeded_running_sum
from tally.operators.deltas import ORDER_RAW, split_hot_counters
from tally.functions import epoch_micros
from tally.sources import testbed as tb
from tests.conftest import READ_SCHEMA, SF01, frame, hourly, ts

PLAIN = RunConfig(split_hot=False)
# More ranges than a hand-made counter has readings: (nearly) every row is a chunk boundary.
CHUNKED = RunConfig(hot_ranges=12)


def time_chunk(ts, seconds):
    """Index of the ``seconds``-wide time chunk holding ``ts`` (null stays null)."""
    return F.floor(epoch_micros(ts) / F.lit(int(seconds) * 1_000_000)).cast("long")


def run(spark, values, cfg=PLAIN, prior=None, id_="c"):
    latest = frame(spark, hourly(id_, values), READ_SCHEMA)
    p = frame(spark, prior, READ_SCHEMA) if prior else None
    raw = raw_deltas(p, latest, cfg)
    direction = dominant_direction(raw, cfg)
    return raw, direction, clean_deltas(raw, direction, cfg)


def deltas(df):
    return [(r.entries, r.d_entries) for r in df.orderBy("datetime", "sign").collect()]


@pytest.mark.parametrize("cfg", [PLAIN, CHUNKED])
def test_d4_reset(spark, cfg):
    raw, direction, clean = run(spark, [100, 110, 50, 60, 70, 80], cfg)
    assert [r.sign for r in direction.collect()] == [1.0]
    assert deltas(clean) == [(70.0, 10.0), (80.0, 10.0)]


@pytest.mark.parametrize("cfg", [PLAIN, CHUNKED])
def test_d4_blip(spark, cfg):
    _, _, clean = run(spark, [100, 110, 50, 130, 140], cfg)
    assert deltas(clean) == [(130.0, 20.0), (140.0, 10.0)]


def test_d4_cap(spark):
    _, _, clean = run(spark, [0, 1, 2, 3, 10002, 20002])
    assert deltas(clean) == [(2.0, 1.0), (3.0, 1.0), (10002.0, 9999.0)]


def test_d3_min_rows(spark):
    _, d4, _ = run(spark, [1, 2, 3, 4], id_="four")
    _, d5, _ = run(spark, [1, 2, 3, 4, 5], id_="five")
    assert d4.count() == 0
    assert [(r.id, r.sign) for r in d5.collect()] == [("five", 1.0)]


@pytest.mark.parametrize("cfg", [PLAIN, CHUNKED])
def test_t9_direction_tie(spark, cfg):
    raw, direction, clean = run(spark, [10, 12, 10, 10, 12, 10], cfg)
    assert sorted(r.sign for r in direction.collect()) == [-1.0, 1.0]
    rows = [(r.entries, r.sign, r.d_entries) for r in clean.orderBy("datetime", "sign").collect()]
    # the zero-delta reading survives once per direction
    assert rows == [(10.0, -1.0, 2.0), (10.0, -1.0, 0.0), (10.0, 1.0, 0.0), (12.0, 1.0, 2.0), (10.0, -1.0, 2.0)]


def test_t1_carry_over_first_and_null_last(spark):
    prior = [("c", ts(8, 8), 5.0)]
    latest = frame(spark, [("c", ts(8, 8), 7.0), ("c", None, 9.0), ("c", ts(8, 9), 8.0)], READ_SCHEMA)
    raw = raw_deltas(frame(spark, prior, READ_SCHEMA), latest, PLAIN)
    got = [(r.src, r.entries, r.d_entries) for r in
           raw.orderBy(F.col("datetime").asc_nulls_last(), "src").collect()]
    assert got == [(0, 5.0, None), (1, 7.0, 2.0), (1, 8.0, 1.0), (1, 9.0, 1.0)]


def test_t6_nan_reading_is_dropped(spark):
    latest = frame(spark, hourly("c", [1, 2, None, 4, 5, 6]), READ_SCHEMA)
    raw = raw_deltas(None, latest, PLAIN)
    clean = clean_deltas(raw, dominant_direction(raw, PLAIN), PLAIN)
    # the null reading and the one after it lose their deltas; 5 counts from 2
    assert deltas(clean) == [(5.0, 3.0), (6.0, 1.0)]


def test_first_interval_option(spark):
    prior = [("c", ts(8, 7), 99.0)]
    keep = RunConfig(split_hot=False, keep_first_interval=True)
    _, _, ref = run(spark, [100, 101, 102, 103, 104], PLAIN, prior)
    _, _, kept = run(spark, [100, 101, 102, 103, 104], keep, prior)
    assert [r.entries for r in ref.orderBy("datetime").collect()] == [101.0, 102.0, 103.0, 104.0]
    assert [r.entries for r in kept.orderBy("datetime").collect()] == [100.0, 101.0, 102.0, 103.0, 104.0]


def test_t12_gap_filter(spark):
    rows = [("c", ts(8, 0), 0.0), ("c", ts(8, 1), 1.0), ("c", ts(8, 2), 2.0), ("c", ts(8, 3), 3.0),
            ("c", ts(8, 15), 4.0), ("c", ts(9, 3, 30), 5.0), ("c", ts(9, 16, 30), 6.0)]
    latest = frame(spark, rows, READ_SCHEMA)
    raw = raw_deltas(None, latest, PLAIN)
    clean = clean_deltas(raw, dominant_direction(raw, PLAIN), PLAIN)
    assert [(r.entries, r.d_time) for r in clean.orderBy("datetime").collect()] == \
        [(2.0, -1), (3.0, -1), (4.0, -12), (5.0, -12)]
    floor = RunConfig(split_hot=False, gap_rounding="floor")
    clean_f = clean_deltas(raw, dominant_direction(raw, floor), floor)
    assert [r.entries for r in clean_f.orderBy("datetime").collect()] == [2.0, 3.0, 4.0]


def test_property_shift_invariance(spark):
    vals = [5, 9, 9, 20, 18, 30, 31, 40]
    _, _, a = run(spark, vals)
    _, _, b = run(spark, [v + 1000 for v in vals])
    assert [r.d_entries for r in a.orderBy("datetime").collect()] == \
        [r.d_entries for r in b.orderBy("datetime").collect()]
    _, _, c = run(spark, [-v for v in vals])
    assert [r.d_entries for r in a.orderBy("datetime").collect()] == \
        [r.d_entries for r in c.orderBy("datetime").collect()]


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_chunked_equals_plain_on_events(spark):
    """The skew-splitting windows give exactly the plain-window results."""
    r_plain = tb.readings_view(spark, SF01, PLAIN)
    r_chunk = tb.readings_view(spark, SF01, RunConfig(hot_ranges=64))
    cols = ["id", "datetime", "entries"]
    assert _rows(r_plain, cols) == _rows(r_chunk, cols)
    prior, latest = tb.prior_snapshot(r_plain, PLAIN), tb.latest_readings(r_plain)
    for cfg in (RunConfig(hot_ranges=64), RunConfig(hot_ranges=12)):
        raw_p = raw_deltas(prior, latest, PLAIN)
        raw_c = raw_deltas(prior, latest, cfg)
        cols = ["id", "datetime", "entries", "src", "d_entries"]
        assert _rows(raw_p, cols) == _rows(raw_c, cols)
        cl_p = clean_deltas(raw_p, dominant_direction(raw_p, PLAIN), PLAIN)
        cl_c = clean_deltas(raw_c, dominant_direction(raw_c, cfg), cfg)
        cols = ["id", "datetime", "entries", "sign", "d_entries", "d_time"]
        assert _rows(cl_p, cols) == _rows(cl_c, cols)


def test_window_vote_equals_vote_table(spark):
    """The per-counter window vote attaches the same directions as the vote table join."""
    r = tb.readings_view(spark, SF01, PLAIN)
    raw = raw_deltas(tb.prior_snapshot(r, PLAIN), tb.latest_readings(r), PLAIN)
    cols = ["id", "datetime", "entries", "sign", "d_entries", "d_time"]
    a = clean_deltas(raw, None, PLAIN)
    b = clean_deltas(raw, dominant_direction(raw, PLAIN), PLAIN)
    assert _rows(a, cols) == _rows(b, cols)
    for vals in ([10, 12, 10, 10, 12, 10], [1, 2, 3, 4], [5, 5, 5, 5, 5, 5]):
        _, d, c1 = run(spark, vals)
        latest = frame(spark, hourly("c", vals), READ_SCHEMA)
        rw = raw_deltas(None, latest, PLAIN)
        assert _rows(c1, cols) == _rows(clean_deltas(rw, None, PLAIN), cols)


def test_hot_counter_split_decision(spark):
    latest = frame(spark, hourly("hot", range(50)) + hourly("cold", range(3)), READ_SCHEMA)
    # 53 readings in ranges of at most 10, a quarter more ranges than needed
    assert split_hot_counters(latest, RunConfig(max_rows_per_key=10)).hot_ranges == 7
    assert split_hot_counters(latest, RunConfig(max_rows_per_key=50)).hot_ranges is None
    assert split_hot_counters(latest, RunConfig(max_rows_per_key=10, split_hot=False)).hot_ranges is None
    assert split_hot_counters(latest, RunConfig(max_rows_per_key=10, hot_ranges=3)).hot_ranges == 3
    assert split_hot_counters(latest.limit(0), RunConfig(max_rows_per_key=0)).hot_ranges is None


def _burst(n):
    """One early reading, the rest within 20 seconds."""
    t0 = ts(8)
    return [("hot", t0, 0.0)] + [("hot", t0 + dt.timedelta(days=6, microseconds=20_000_000 * i // n), float(i)) for i in range(1, n)]


def _timeless(n):
    """Nine readings in ten have no time."""
    return [("hot", ts(8) + dt.timedelta(seconds=i) if i % 10 == 0 else None, float(i)) for i in range(n)]


@pytest.mark.parametrize("make", [_burst, _timeless])
def test_hot_counter_is_split_by_rank(spark, make):
    """Bursts and readings without a time are split like any others, with the plain result."""
    latest = frame(spark, make(20_000) + hourly("cold", range(9)), READ_SCHEMA)
    cfg = split_hot_counters(latest, RunConfig(max_rows_per_key=1000))
    raw = raw_deltas(None, latest, cfg)
    largest = raw.groupBy("id", "chunk").count().agg(F.max("count")).first()[0]
    assert largest <= 1300, largest
    plain = raw_deltas(None, latest, PLAIN)

    def digest(df, *cols):  # order-free; nulls count as a value
        return df.select(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]).cast("decimal(38,0)").alias("h")) \
            .agg(F.count("h"), F.sum("h")).first()

    assert digest(raw, "id", "datetime", "entries", "src", "d_entries") == digest(plain, "id", "datetime", "entries", "src", "d_entries")
    cols = ["id", "datetime", "entries", "sign", "d_entries", "d_time"]
    assert digest(clean_deltas(raw, None, cfg), *cols) == digest(clean_deltas(plain, None, PLAIN), *cols)
    cols = ["id", "datetime", "entries", "d_entries"]
    assert digest(latest_per_counter(raw, cfg), *cols) == digest(latest_per_counter(plain, PLAIN), *cols)


def test_only_hot_counters_are_dealt_anew(spark):
    """Counters below the bound stay whole on the hash exchange: no range exchange, and only hot rows leave chunk 0."""
    t0 = ts(8)
    cold = [(f"c{i}", t0 + dt.timedelta(minutes=7 * k), float(k)) for i in range(40) for k in range(50)]
    hot = [("hot", t0 + dt.timedelta(seconds=(k * 7919) % 5000), float(k)) for k in range(4000)] + [(None, None, float(k)) for k in range(3000)]
    latest = frame(spark, cold + hot, READ_SCHEMA)
    cfg = split_hot_counters(latest, RunConfig(max_rows_per_key=500))
    raw = raw_deltas(None, latest, cfg)
    per = {(r.id, r.chunk): r["count"] for r in raw.groupBy("id", "chunk").count().collect()}
    assert {k: n for k, n in per.items() if k[0] not in ("hot", None)} == {(f"c{i}", 0): 50 for i in range(40)}
    moved = sum(n for (i, c), n in per.items() if c)
    assert 0 < moved <= 7000 and max(per.values()) <= 650
    assert len({c for i, c in per if i == "hot"}) >= 8 and len({c for i, c in per if i is None}) >= 6
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "BroadcastHashJoin" in plan
    # the same rows in other parts have the same bounds
    again = raw_deltas(None, latest.repartition(13), cfg)
    assert {(r.id, r.chunk): r["count"] for r in again.groupBy("id", "chunk").count().collect()} == per
    plain = raw_deltas(None, latest, PLAIN)
    cols = ["id", "datetime", "entries", "d_entries"]
    assert sorted(map(str, raw.select(*cols).collect())) == sorted(map(str, plain.select(*cols).collect()))


def test_many_ranges_deal_all_rows_by_rank(spark, monkeypatch):
    from tally.operators import chunked
    latest = frame(spark, hourly("hot", range(60)) + hourly("cold", range(9)), READ_SCHEMA)
    cfg = RunConfig(hot_ranges=12)
    want = sorted(map(str, raw_deltas(None, latest, cfg).drop("chunk").collect()))
    monkeypatch.setattr(chunked, "MAX_RANGES", 1)
    assert sorted(map(str, raw_deltas(None, latest, cfg).drop("chunk").collect())) == want


def test_small_ranges_share_tasks(spark, monkeypatch):
    """Many ranges of a few rows make no task or file each; ties moving both ways stay together."""
    from tally.operators import chunked
    t0 = ts(8)
    moves = [(f"c{i}", t0 + dt.timedelta(minutes=20 * (k // 3)), float((k // 3 + k % 3) * (-1) ** i)) for i in range(7) for k in range(900)]
    even = [("even", t0 + dt.timedelta(minutes=20 * (k // 2)), float(k // 4 % 2)) for k in range(600)]
    latest = frame(spark, moves + even + [(None, None, float(k)) for k in range(500)] + hourly("cold", range(9)), READ_SCHEMA)
    monkeypatch.setattr(chunked, "MAX_RANGES", 1)
    monkeypatch.setattr(chunked, "PART_ROWS", 2000, raising=False)
    cfg = split_hot_counters(latest, RunConfig(max_rows_per_key=4))
    assert cfg.hot_ranges > 2000
    order = [("datetime", True), ("entries", True)]
    dealt = chunked.rank_chunks(latest, ["id"], order, cfg.hot_ranges)
    assert len(dealt.inputFiles()) <= 4
    sizes = dealt.groupBy("id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("datetime", "entries").alias("kinds"))
    assert sizes.where("n > 5 and kinds > 1").count() == 0 and sizes.count() > 1000
    tied = dealt.groupBy("id", "datetime", "entries").agg(F.countDistinct("chunk").alias("n"))
    assert tied.where("n > 1").count() == 0
    raw, plain = raw_deltas(None, latest, cfg), raw_deltas(None, latest, PLAIN)

    def rows(df, *cols):
        return sorted(map(str, df.select(*cols).collect()))

    assert rows(raw, "id", "datetime", "entries", "src", "d_entries") == rows(plain, "id", "datetime", "entries", "src", "d_entries")
    cols = ["id", "datetime", "entries", "sign", "d_entries", "d_time"]
    assert rows(clean_deltas(raw, None, cfg), *cols) == rows(clean_deltas(plain, None, PLAIN), *cols)


def test_seeded_running_sum_matches_plain(spark):
    rows = [("k" if i % 3 else "h", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v long")
    order = [("t", True)]
    a = seeded_running_sum(df, ["k"], order, "v", "s", None)
    b = seeded_running_sum(df, ["k"], order, "v", "s", time_chunk("t", 7200))
    assert _rows(a, ["k", "t", "s"]) == _rows(b, ["k", "t", "s"])
    la = seeded_lag(df, ["k"], order, ["v", "t"], None)
    lb = seeded_lag(df, ["k"], order, ["v", "t"], time_chunk("t", 10800))
    assert _rows(la, ["k", "t", "prev_v", "prev_t"]) == _rows(lb, ["k", "t", "prev_v", "prev_t"])
