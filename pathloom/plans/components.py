"""Connected components of an undirected edge list, as repeated joins and aggregates.

Each round is a large-star and a small-star step: every node's larger (then smaller)
neighbours are re-hung on the smallest node it knows.  The number of rounds grows with
the logarithm of the longest chain, never with the number of nodes, and nothing but
two checksums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.plans.scratch import drop, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge that joins two different nodes.

    ``component`` is the smallest node id reachable.  Null ends and self-loops carry no
    link and are ignored; repeated edges count once; an empty input gives no rows.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(),
        "cc",
    )
    seen = _mark(now)
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(now)), "cc")
        drop(now)
        mark, now = _mark(after), after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return ends.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return tuple(row)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
    return hung.select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).where("u <> v").distinct()
