"""Null-safe joins, broadcasts by bytes and shuffle sizes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tally.operators.joins import held_frames, hold, join_nullsafe, release
from tally.session import shuffle_partitions_for, size_shuffles


def test_broadcast_follows_the_bytes(spark):
    """No side is marked; Spark broadcasts a side only below its threshold of bytes."""
    big, small = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).selectExpr("id as k", "id as v")

    def plan():
        df = join_nullsafe(big, small, ["k"], "left")
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    assert "BroadcastHashJoin" in plan()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "BroadcastHashJoin" not in plan() and "NestedLoop" not in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shuffle_partitions_follow_the_input(spark, tmp_path):
    assert shuffle_partitions_for(0, 8) == 8
    assert shuffle_partitions_for((256 << 20) * 400 + 1, 200) == 401
    assert shuffle_partitions_for(100 << 40, 200) == 409_600
    (tmp_path / "a.txt").write_text("x" * 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert size_shuffles(spark, [str(tmp_path / "a.txt"), str(tmp_path / "none*.txt")]) == int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_nullsafe_join_suffixes(spark):
    a = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "k string, v double")
    b = spark.createDataFrame([(None, 3.0), ("y", 4.0)], "k string, v double")
    full = join_nullsafe(a, b, ["k"], "full", suffixes=("_a", "_b"))
    assert full.columns == ["k", "v_a", "v_b"]
    assert sorted(str(tuple(r)) for r in full.collect()) == sorted(map(str, [
        (None, 1.0, 3.0), ("x", 2.0, None), ("y", None, 4.0)]))


def test_checkpoint_dir_is_read_from_the_session(spark):
    import tempfile

    from tally.session import ensure_checkpoint_dir

    named = tempfile.mkdtemp(prefix="tally-shared-")
    spark.sparkContext.setCheckpointDir(named)
    got = ensure_checkpoint_dir(spark)
    assert got == spark.sparkContext.getCheckpointDir()
    assert got.rstrip("/").split("/")[-2].startswith("tally-shared-") or named in got


def test_held_frames_have_merged_partitions(spark):
    """A small held frame has few partitions, whatever the session's number, and is still partitioned by its key."""
    old, since = spark.conf.get("spark.sql.shuffle.partitions"), held_frames()
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(2000).selectExpr("cast(id % 97 as string) as id", "id as x")
        raw = hold(df.withColumn("prev", F.lag("x").over(Window.partitionBy("id").orderBy("x"))))
        assert raw.count() == 2000 and raw.rdd.getNumPartitions() < 64
        top = raw.withColumn("top", F.max("x").over(Window.partitionBy("id")))
        assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert sorted(r[0] for r in top.where("x = top").select("x").collect()) == list(range(1903, 2000))
    finally:
        release(since)
        spark.conf.set("spark.sql.shuffle.partitions", old)
