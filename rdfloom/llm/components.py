"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rdfloom.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Every round keeps connectivity and points nodes at smaller ones: minima are
    pre-aggregated on each node before the join, so that a node of very high degree
    costs its edges once and no task holds a neighbourhood. Each round is cut with
    checkpoint(); rounds grow with the logarithm of the longest chain. Null ends
    and loops are dropped; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = cut(e)
    mark = None
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), F.col("m")).union(down.select("a", "m")).where("x != m").distinct().toDF("a", "b")
        e = cut(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()
        mark = now
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
