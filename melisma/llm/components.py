"""Connected components of an edge table, without gathering edges or a node's neighbours in one place.

Large-star and small-star steps alternate until nothing changes. Each step needs only the smallest neighbour of a node,
so it is an aggregation with partial sums followed by a join that adaptive execution can split for a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melisma.llm.common import forget, written

ROUNDS = 60


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("m").alias("a"), "b")


def _small(e: DataFrame) -> DataFrame:
    # edges point from the smaller a to the larger b; b's lesser neighbours and b itself go to the least of them
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    return e.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges a, b; self-loops count for nothing."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = written(e, "edges")
    state = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.count_distinct("b")).first()
        # done when every larger node hangs on one root and no root hangs on another
        if mark == state or not mark[0]:
            break
        state = mark
        following = written(_small(_large(now)).distinct(), "edges")
        forget(now)
        now = following
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
