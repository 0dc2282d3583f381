"""Connected components of an undirected graph by alternating stars, on DataFrames alone.

Each round hangs every node's larger neighbours under its smallest one (large star), then its smaller ones
(small star), until nothing moves; rounds grow with the logarithm of the longest path. Only two sums come to
the driver. Each round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of each node of an edge; root is the smallest node reachable. Loops and repeated edges don't matter."""
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo <> hi").distinct()
    e = stored(e, "components")
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == seen:
            break
        seen = tuple(now)
        e = stored(_small(_large(e)), "components")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    up = both.filter("v > u").join(least, "u")
    return up.select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    down = e.join(least, "hi")
    moved = down.select(F.col("m").alias("a"), F.col("lo").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("hi").alias("b")))
    return moved.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
