"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join on the
node; edges are kept as a written table after every round, so lineage stays
short and nothing but two numbers a round reaches the driver.  The number of
edges never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import discard, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node that has an edge; root: its component's smallest node.

    Nulls and self-loops are no edges; repeated edges count once; an empty table
    gives an empty result.  Raises if ``max_rounds`` rounds don't settle it
    (the number of rounds grows with the logarithm of the largest component).
    """
    now = keep(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())

    def mark(df):
        r = df.select(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return r["n"], r["x"]

    before = None
    for _ in range(max_rounds):
        after = keep(_small_star(_large_star(now)))
        discard(now)
        now, sign = after, mark(after)
        if sign[0] == 0 or sign == before:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sign
    raise RuntimeError("components did not settle")
