"""Brute-force DuckDB SQL for every catalog query (the correctness oracle).

Written directly from the reference's semantics, not from the Spark code:
plain windows over whole counters, joins before aggregation, IEEE division.
Tables ``events nation region orders`` are views supplied by the checker.
DuckDB notes: ``dayofweek`` is Sunday 0, ``sign`` is TINYINT, ``sum(BIGINT)``
is HUGEINT, ``||`` propagates nulls, ``x/0.0`` is IEEE.
"""

from __future__ import annotations

# Readings view, prior snapshot, this run's readings, station lookup.
_BASE = """
r AS (
  SELECT CAST(e.user_id AS VARCHAR) AS id, e.ts AS datetime,
         CAST(CASE WHEN e.user_id % 7 = 0 THEN -1 ELSE 1 END
              * SUM(CAST(ROUND(e.value * 100) AS BIGINT)) OVER (
                  PARTITION BY e.user_id ORDER BY e.ts, e.event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS entries,
         n.n_name AS station, g.r_name AS linename
  FROM events e
  JOIN nation n ON n.n_nationkey = e.user_id % 25
  JOIN region g ON g.r_regionkey = n.n_regionkey
),
mid AS (
  SELECT CAST(make_timestamp((epoch_us(min(datetime)) + epoch_us(max(datetime))) // 2) AS DATE) AS d FROM r
),
split AS (SELECT CAST(d - CAST((dayofweek(d) + 1) % 7 AS INTEGER) AS TIMESTAMP) AS start FROM mid),
prior AS (
  SELECT id, datetime, entries, station, linename FROM (
    SELECT *, max(datetime) OVER (PARTITION BY id) AS mx FROM r
    WHERE datetime < (SELECT start FROM split) AND CAST(id AS BIGINT) % 10 <> 3)
  WHERE datetime = mx
),
latest AS (
  SELECT * FROM r WHERE datetime >= (SELECT start FROM split) OR datetime IS NULL
),
stations AS (
  SELECT n.n_name AS station, g.r_name AS linename, n.n_name || '_ST' AS station_new,
         lower(g.r_name) AS linename_new, n.n_regionkey AS borough_id
  FROM nation n JOIN region g ON g.r_regionkey = n.n_regionkey
  WHERE n.n_nationkey % 5 <> 4
),
names AS (SELECT DISTINCT id, station, linename FROM r)"""


def _chain(p: str, prior: str | None, latest: str) -> str:
    """CTEs ``{p}raw {p}dir {p}clean {p}bk`` for readings ``latest`` (+ carry-over ``prior``)."""
    union = f"SELECT id, datetime, entries, 1 AS src FROM {latest}"
    if prior:
        union = f"SELECT id, datetime, entries, 0 AS src FROM {prior} UNION ALL " + union
    return f"""
{p}u AS ({union}),
{p}raw AS (
  SELECT id, datetime, entries, src,
         entries - lag(entries) OVER (PARTITION BY id ORDER BY datetime ASC NULLS LAST, src,
                                      entries ASC NULLS LAST) AS d_entries
  FROM {p}u
),
{p}g AS (
  SELECT id, CAST(sign(d_entries) AS DOUBLE) AS sign, count(*) AS n FROM {p}raw GROUP BY ALL
),
{p}v AS (
  SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS total FROM {p}g)
  WHERE total >= 5 AND sign <> 0 AND NOT isnan(sign)
),
{p}dir AS (
  SELECT id, sign FROM (SELECT *, max(n) OVER (PARTITION BY id) AS top FROM {p}v) WHERE n = top
),
{p}j AS (
  SELECT x.id, x.datetime, x.entries, x.src, d.sign, x.d_entries
  FROM {p}raw x LEFT JOIN {p}dir d ON x.id IS NOT DISTINCT FROM d.id
),
{p}s AS (
  SELECT id, datetime, entries, src, sign,
         (entries - lag(entries) OVER w) * sign AS d_entries,
         CAST(trunc((epoch_us(lag(datetime) OVER w) - epoch_us(datetime)) / 3600000000.0) AS BIGINT) AS d_time
  FROM {p}j WHERE sign * d_entries >= 0 AND NOT isnan(sign * d_entries)
  WINDOW w AS (PARTITION BY id ORDER BY datetime ASC NULLS LAST, src, entries ASC NULLS LAST, sign)
),
{p}clean AS (SELECT * FROM {p}s WHERE d_entries < 10000 AND d_entries >= 0 AND d_time >= -12),
{p}bk AS (
  SELECT *, date_trunc('week', datetime) AS weekdate,
         CASE WHEN dayofweek(datetime) IN (0, 6) THEN 'weekend'
              WHEN hour(datetime) <= 11 THEN 'weekday_am'
              WHEN hour(datetime) > 11 THEN 'weekday_pm' END AS time
  FROM {p}clean
  WHERE hour(datetime) IN (8, 9, 10, 11, 18, 19, 20, 21) OR dayofweek(datetime) IN (0, 6)
)"""


def _weekly(p: str, names: str) -> str:
    """CTE ``{p}wk``: join every bucketed reading to its names, then roll up."""
    return f"""
{p}jn AS (
  SELECT nm.linename, nm.station, b.weekdate, b.time, b.d_entries
  FROM {p}bk b LEFT JOIN (SELECT id, station, linename FROM {names}) nm ON b.id IS NOT DISTINCT FROM nm.id
),
{p}wk AS (
  SELECT linename, station, weekdate,
         sum(d_entries) FILTER (WHERE time = 'weekend') AS weekend,
         sum(d_entries) FILTER (WHERE time = 'weekday_am') AS weekday_am,
         sum(d_entries) FILTER (WHERE time = 'weekday_pm') AS weekday_pm,
         CAST(date_diff('day', date_trunc('year', weekdate), weekdate) // 7 + 1 AS INTEGER) AS week
  FROM {p}jn GROUP BY linename, station, weekdate
)"""


def _snapshot(p: str, raw: str, prior: str, latest: str) -> str:
    """CTEs ``{p}lat {p}sj {p}snap``: latest rows, full join with the prior, branch C1."""
    return f"""
{p}top AS (
  SELECT id, max(datetime) AS mx, bool_or(datetime IS NULL) AS anynull FROM {raw} GROUP BY id
),
{p}lat AS (
  SELECT x.id, x.datetime, x.entries, x.d_entries
  FROM {raw} x JOIN {p}top t ON x.id IS NOT DISTINCT FROM t.id AND x.datetime = t.mx
  WHERE NOT t.anynull
),
{p}sj AS (
  SELECT coalesce(l.id, q.id) AS id, l.datetime, l.entries, l.d_entries, q.station, q.linename
  FROM {p}lat l FULL JOIN (SELECT id, station, linename FROM {prior}) q ON l.id IS NOT DISTINCT FROM q.id
),
{p}grew AS (SELECT (SELECT count(*) FROM {p}sj) > (SELECT count(*) FROM {prior}) AS g),
{p}new_ts AS (
  SELECT s.id, s.datetime, s.entries,
         coalesce(st.station_new, nm.station) AS station,
         coalesce(st.linename_new, nm.linename) AS linename
  FROM (SELECT id, datetime, entries FROM {p}sj WHERE station IS NULL) s
  LEFT JOIN (SELECT DISTINCT id, station, linename FROM {latest}) nm ON s.id IS NOT DISTINCT FROM nm.id
  LEFT JOIN stations st ON nm.station IS NOT DISTINCT FROM st.station
                       AND nm.linename IS NOT DISTINCT FROM st.linename
),
{p}snap AS (
  SELECT id, datetime, entries, station, linename FROM {p}sj
  WHERE station IS NOT NULL AND (SELECT g FROM {p}grew)
  UNION ALL SELECT * FROM {p}new_ts WHERE (SELECT g FROM {p}grew)
  UNION ALL SELECT id, datetime, entries, station, linename FROM {p}sj WHERE NOT (SELECT g FROM {p}grew)
)"""


_LATEST_ROWS = _snapshot("", "raw", "prior", "latest")


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


_RUN = _BASE + "," + _chain("", "prior", "latest")

_BASELINE_CMP = """
base AS (
  SELECT linename, station, week,
         CASE WHEN station IN ('NATION_1', 'NATION_6') THEN 0.0 ELSE weekend END AS weekend,
         CASE WHEN station IN ('NATION_2', 'NATION_7') THEN NULL ELSE weekday_am END AS weekday_am,
         weekday_pm, weekdate AS base_weekdate
  FROM b_wk
),
bj AS (
  SELECT w.linename, w.station, w.weekdate, w.week,
         w.weekend AS weekend_2022, w.weekday_am AS weekday_am_2022, w.weekday_pm AS weekday_pm_2022,
         b.weekend AS weekend_bl, b.weekday_am AS weekday_am_bl, b.weekday_pm AS weekday_pm_bl,
         b.base_weekdate,
         w.weekend / b.weekend AS d_weekend,
         w.weekday_am / b.weekday_am AS d_weekday_am,
         w.weekday_pm / b.weekday_pm AS d_weekday_pm
  FROM a_wk w LEFT JOIN base b
    ON w.linename IS NOT DISTINCT FROM b.linename AND w.station IS NOT DISTINCT FROM b.station
   AND w.week IS NOT DISTINCT FROM b.week
),
ni AS (
  SELECT linename, station, weekdate, week,
         CASE WHEN weekend_2022 = 'inf'::DOUBLE THEN NULL ELSE weekend_2022 END AS weekend_2022,
         CASE WHEN weekday_am_2022 = 'inf'::DOUBLE THEN NULL ELSE weekday_am_2022 END AS weekday_am_2022,
         CASE WHEN weekday_pm_2022 = 'inf'::DOUBLE THEN NULL ELSE weekday_pm_2022 END AS weekday_pm_2022,
         CASE WHEN weekend_bl = 'inf'::DOUBLE THEN NULL ELSE weekend_bl END AS weekend_bl,
         CASE WHEN weekday_am_bl = 'inf'::DOUBLE THEN NULL ELSE weekday_am_bl END AS weekday_am_bl,
         CASE WHEN weekday_pm_bl = 'inf'::DOUBLE THEN NULL ELSE weekday_pm_bl END AS weekday_pm_bl,
         base_weekdate,
         CASE WHEN d_weekend = 'inf'::DOUBLE THEN NULL ELSE d_weekend END AS d_weekend,
         CASE WHEN d_weekday_am = 'inf'::DOUBLE THEN NULL ELSE d_weekday_am END AS d_weekday_am,
         CASE WHEN d_weekday_pm = 'inf'::DOUBLE THEN NULL ELSE d_weekday_pm END AS d_weekday_pm
  FROM bj
)"""


def _all_weeks(runs: int = 4) -> str:
    """The chained runs: files cut to seconds, first week as the state, then ``runs`` weeks, the last one open-ended.

    ``runs`` must not exceed what the supplied events span; weeks without readings pass the state on.
    """
    parts = [_BASE, """
f AS (
  SELECT 'A' || lpad(id, 4, '0') || '_R' || lpad(CAST(CAST(id AS BIGINT) % 25 AS VARCHAR), 3, '0') || '_00-00-00' AS id,
         CAST(id AS BIGINT) AS uid, date_trunc('second', datetime) AS datetime, entries, station, linename FROM r
),
first_day AS (SELECT CAST(min(CAST(datetime AS DATE) - CAST((dayofweek(datetime) + 1) % 7 AS INTEGER)) AS TIMESTAMP) AS d FROM r),
names0 AS (SELECT DISTINCT id, station, linename FROM f),
early AS (SELECT id, datetime, entries FROM f WHERE datetime < (SELECT d FROM first_day) + INTERVAL 7 DAY),
snap0 AS (
  SELECT 'A' || lpad(id, 4, '0') || '_R' || lpad(CAST(CAST(id AS BIGINT) % 25 AS VARCHAR), 3, '0') || '_00-00-00' AS id,
         date_trunc('second', datetime) AS datetime, entries, station, linename
  FROM (SELECT *, max(datetime) OVER (PARTITION BY id) AS mx FROM r
        WHERE datetime < (SELECT d FROM first_day) + INTERVAL 7 DAY AND CAST(id AS BIGINT) % 10 <> 3)
  WHERE datetime = mx
)""", _chain("b_", None, "early"), _weekly("b_", "names0"), """
acc0 AS (SELECT linename, station, weekdate, week, weekend, weekday_am, weekday_pm FROM b_wk)"""]
    prior = "snap0"
    for i in range(1, runs + 1):
        p, end = f"k{i}_", f"AND datetime < (SELECT d FROM first_day) + INTERVAL {7 * i + 7} DAY"
        parts += [f"""
file{i} AS (
  SELECT id, datetime, entries, station, linename FROM f
  WHERE uid % 50 <> 49 AND (datetime >= (SELECT d FROM first_day) + INTERVAL {7 * i} DAY {end if i < runs else "OR datetime IS NULL"})
)""", _chain(p, prior, f"file{i}"), _snapshot(p, f"{p}raw", prior, f"file{i}"), _weekly(p, f"{p}snap"), f"""
acc{i} AS (
  SELECT coalesce(n.linename, o.linename) AS linename, coalesce(n.station, o.station) AS station,
         coalesce(n.weekdate, o.weekdate) AS weekdate, coalesce(n.week, o.week) AS week,
         coalesce(n.weekend, o.weekend) AS weekend, coalesce(n.weekday_am, o.weekday_am) AS weekday_am,
         coalesce(n.weekday_pm, o.weekday_pm) AS weekday_pm
  FROM {p}wk n FULL JOIN acc{i - 1} o
    ON n.linename IS NOT DISTINCT FROM o.linename AND n.station IS NOT DISTINCT FROM o.station
   AND n.weekdate IS NOT DISTINCT FROM o.weekdate AND n.week IS NOT DISTINCT FROM o.week
)"""]
        prior = f"{p}snap"
    compare = _BASELINE_CMP
    for old, new in (("CASE WHEN station IN ('NATION_1', 'NATION_6') THEN 0.0 ELSE weekend END AS weekend", "weekend"),
                     ("CASE WHEN station IN ('NATION_2', 'NATION_7') THEN NULL ELSE weekday_am END AS weekday_am", "weekday_am"),
                     ("weekdate AS base_weekdate", "strftime(weekdate, '%Y-%m-%d') AS base_weekdate"), ("a_wk", f"acc{runs}")):
        assert old in compare
        compare = compare.replace(old, new)
    return _with(*parts, compare) + """
SELECT st.linename_new AS linename, st.station_new AS station, ni.weekdate, ni.week,
       ni.weekend_2022, ni.weekday_am_2022, ni.weekday_pm_2022,
       ni.weekend_bl, ni.weekday_am_bl, ni.weekday_pm_bl, ni.base_weekdate,
       ni.d_weekend, ni.d_weekday_am, ni.d_weekday_pm, CAST(st.borough_id AS VARCHAR) AS borough_id
FROM ni LEFT JOIN stations st
  ON ni.linename IS NOT DISTINCT FROM st.linename AND ni.station IS NOT DISTINCT FROM st.station"""


ORACLE = {
    "flagship_weekly_counts": _with(_BASE, _chain("", None, "r"), _weekly("", "names"))
    + "SELECT * FROM wk",

    "anti_set_filter": """
SELECT event_id, event_type FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type FROM events)
WHERE event_type IS NULL OR event_type NOT IN ('error', 'signup')""",

    "compose_id": """
SELECT o_orderkey,
       o_orderstatus || '_' || (CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END)
       || '_' || CAST(o_custkey AS VARCHAR) AS id
FROM orders""",

    "parse_timestamp": """
SELECT o_orderkey, s, try_strptime(s, '%m/%d/%Y %H:%M:%S') AS datetime FROM (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 17 = 0 THEN 'garbage'
              ELSE CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
                        ELSE strftime(o_orderdate, '%-m/%-d/%Y') END
                   || ' ' || CAST(o_orderkey % 24 AS VARCHAR)
                   || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')
                   || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') END AS s
  FROM orders)""",

    "raw_deltas": _with(_RUN) + "SELECT id, datetime, entries, src, d_entries FROM raw",

    "dominant_direction": _with(_RUN) + "SELECT id, sign FROM dir",

    "clean_deltas": _with(_RUN)
    + "SELECT id, datetime, entries, src, sign, d_entries, d_time FROM clean",

    "latest_per_counter": _with(_RUN, _LATEST_ROWS) + "SELECT * FROM lat",

    "snapshot_full_join": _with(_RUN, _LATEST_ROWS) + "SELECT * FROM sj",

    "new_counter_enrichment": _with(_RUN, _LATEST_ROWS) + "SELECT * FROM snap",

    "time_bucket": """
SELECT event_id, ts AS datetime, date_trunc('week', ts) AS weekdate,
       CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend'
            WHEN hour(ts) <= 11 THEN 'weekday_am'
            WHEN hour(ts) > 11 THEN 'weekday_pm' END AS time
FROM events
WHERE hour(ts) IN (8, 9, 10, 11, 18, 19, 20, 21) OR dayofweek(ts) IN (0, 6)""",

    "weekly_pivot": _with(_RUN, _LATEST_ROWS, _weekly("", "snap")) + "SELECT * FROM wk",

    "week_number": """
SELECT o_orderkey, o_orderdate,
       CAST(date_diff('day', date_trunc('year', o_orderdate), o_orderdate) // 7 + 1 AS INTEGER) AS week
FROM orders""",

    "merge_weekly": _with(
        _BASE,
        "\nold_r AS (SELECT * FROM r WHERE datetime < (SELECT start FROM split) + INTERVAL 108 HOUR)",
        "\nnew_r AS (SELECT * FROM r WHERE datetime >= (SELECT start FROM split) + INTERVAL 108 HOUR OR datetime IS NULL)",
        _chain("o_", None, "old_r"), _weekly("o_", "names"),
        _chain("n_", None, "new_r"), _weekly("n_", "names")) + """
SELECT coalesce(n.linename, o.linename) AS linename, coalesce(n.station, o.station) AS station,
       coalesce(n.weekdate, o.weekdate) AS weekdate, coalesce(n.week, o.week) AS week,
       coalesce(n.weekend, o.weekend) AS weekend,
       coalesce(n.weekday_am, o.weekday_am) AS weekday_am,
       coalesce(n.weekday_pm, o.weekday_pm) AS weekday_pm
FROM n_wk n FULL JOIN o_wk o
  ON n.linename IS NOT DISTINCT FROM o.linename AND n.station IS NOT DISTINCT FROM o.station
 AND n.weekdate IS NOT DISTINCT FROM o.weekdate AND n.week IS NOT DISTINCT FROM o.week""",

    "baseline_ratio": _with(
        _BASE,
        "\nearly_r AS (SELECT * FROM r WHERE datetime < (SELECT start FROM split) + INTERVAL 2 DAY)",
        _chain("a_", None, "r"), _weekly("a_", "names"),
        _chain("b_", None, "early_r"), _weekly("b_", "names"), _BASELINE_CMP) + """
SELECT st.linename_new AS linename, st.station_new AS station, ni.weekdate, ni.week,
       ni.weekend_2022, ni.weekday_am_2022, ni.weekday_pm_2022,
       ni.weekend_bl, ni.weekday_am_bl, ni.weekday_pm_bl, ni.base_weekdate,
       ni.d_weekend, ni.d_weekday_am, ni.d_weekday_pm, st.borough_id
FROM ni LEFT JOIN stations st
  ON ni.linename IS NOT DISTINCT FROM st.linename AND ni.station IS NOT DISTINCT FROM st.station""",

    "week_file_date": """
SELECT o_orderkey, file_date, strftime(file_date, '%y%m%d') AS file_tag,
       CAST(file_date - INTERVAL 7 DAY AS DATE) AS prior_date
FROM (SELECT o_orderkey,
             CAST(CAST(o_orderdate AS DATE) - CAST((dayofweek(o_orderdate) + 1) % 7 AS INTEGER) AS DATE)
               AS file_date
      FROM orders)""",

    "multi_file_union": "SELECT o_orderkey, o_orderpriority AS c_a, o_totalprice FROM orders",

    "read_readings": _with(_BASE) + """
SELECT 'A' || lpad(id, 4, '0') || '_R' || lpad(CAST(CAST(id AS BIGINT) % 25 AS VARCHAR), 3, '0') || '_00-00-00'
         AS id,
       date_trunc('second', datetime) AS datetime, station, linename, entries
FROM r WHERE CAST(id AS BIGINT) % 50 <> 49""",

    # the first run's readings are those of one week, the second's all later ones
    "second_week_snapshot": _with(
        _BASE,
        "\nlatest1 AS (SELECT * FROM r WHERE datetime >= (SELECT start FROM split)"
        " AND datetime < (SELECT start FROM split) + INTERVAL 7 DAY)",
        _chain("w1_", "prior", "latest1"), _snapshot("w1_", "w1_raw", "prior", "latest1"),
        "\nlatest2 AS (SELECT * FROM r WHERE datetime >= (SELECT start FROM split) + INTERVAL 7 DAY OR datetime IS NULL)",
        _chain("w2_", "w1_snap", "latest2"), _snapshot("w2_", "w2_raw", "w1_snap", "latest2"))
    + "SELECT * FROM w2_snap",

    "snapshot_distinct_names": _with(
        _BASE, "\ntwice AS (SELECT * FROM prior UNION ALL SELECT * FROM prior)",
        _chain("", "twice", "latest"), _LATEST_ROWS) + """
SELECT coalesce(l.id, q.id) AS id, l.datetime, l.entries, l.d_entries, q.station, q.linename
FROM lat l FULL JOIN (SELECT DISTINCT id, station, linename FROM prior) q ON l.id IS NOT DISTINCT FROM q.id""",

    "all_weeks_run": _all_weeks(),

    # a correction that lands late changes nothing in the end
    "late_file_run": _all_weeks(),

    "one_plan_run": _all_weeks(),

    "parse_mixed_separators": """
SELECT o_orderkey, s, try_strptime(trim(regexp_replace(s, '[^0-9a-z]+', ' ', 'g')), '%m %d %Y %H %M %S') AS datetime FROM (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN replace(s, '/', '-')
         WHEN 1 THEN replace(replace(s, '/', '.'), ':', '.') WHEN 2 THEN replace(replace(s, '/', ' '), ':', ' ')
         WHEN 3 THEN ' ' || replace(replace(s, '/', '-'), ':', '.') || '  ' ELSE s END AS s
  FROM (
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 17 = 0 THEN 'garbage'
                ELSE CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
                          ELSE strftime(o_orderdate, '%-m/%-d/%Y') END
                     || ' ' || CAST(o_orderkey % 24 AS VARCHAR)
                     || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')
                     || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') END AS s
    FROM orders))""",

    "new_counters_written": _with(_RUN, _LATEST_ROWS) + "SELECT * FROM new_ts WHERE (SELECT g FROM grew)",

    "counted_snapshot": _with(
        _BASE, "\ntwice AS (SELECT * FROM prior UNION ALL SELECT * FROM prior)",
        _chain("", "twice", "latest"), _snapshot("", "raw", "twice", "latest")) + """
SELECT id, datetime, entries, station, linename, count(*) AS copies FROM snap GROUP BY ALL""",
}

# The hot-counter plans compute the same results.
for _name in ("raw_deltas", "clean_deltas", "latest_per_counter", "flagship_weekly_counts"):
    ORACLE[_name + "_split"] = ORACLE[_name]
