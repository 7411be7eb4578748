"""The registered queries: names, plans without nested loops, SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as E
from tally.llm.licenses import TEMPLATES
from tally.llm.queries import ORACLE, QUERIES
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_nested_loops(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    r = compare(spark, SF, name, E.queries()[name], ORACLE[name])
    assert r["ok"], r


@pytest.mark.parametrize("name", ["op4_licenses", "op5_backoff", "op8_suffix_dedup", "op12_runs", "op13_spelling"])
def test_sql_of_odd_rows(spark, tmp_path, name):
    """Nulls, empty texts, repeated rows, periods, overlapping repeats, letters beyond ASCII, blanks of all kinds."""
    tail = "naïveté " * 40
    texts = [None, "", " \t\n", "a " * 30, "x" * 500, tail, tail, "so " + tail + "it goes", "a b c " * 9 + "\x0b a b c d " * 7, "ÀÉÎÕÜßÿ÷× " * 25,
             "surround surronud surround sourround", "é" * 150 + "ü", "surround " * 60, "surroun " * 3 + "surrounds " * 2,
             "Über " + TEMPLATES[2][1].upper() + TEMPLATES[0][1] * 3, TEMPLATES[1][1][8:] + " " + TEMPLATES[1][1]]
    rows = [(None if i % 5 == 4 else i % 7, t) for i, t in enumerate(texts * 6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    r = compare(spark, str(tmp_path), name, E.queries()[name], ORACLE[name], con)
    assert r["ok"] and r["spark_rows"] and not r["type_diff"], r


def test_shuffles_follow_the_bytes(spark, tmp_path):
    from tally.llm.common import partitions
    from tally.llm.queries import apply_settings
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(1)
    assert partitions(df) == before and partitions(df, 1) == before
    assert partitions(df, 1000 * (256 << 20) + 1) == 1001
    with open(tmp_path / "documents.parquet", "wb") as f:
        f.truncate((before + 2) * (256 << 20))  # a sparse file
    try:
        apply_settings(spark, str(tmp_path))
        assert partitions(df) == before + 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(before))
