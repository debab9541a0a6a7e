"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import new_folder, remove

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours go to the least of them; needs a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): for each node of an edge, the least node that it reaches.

    Self-loops and edges with a null end are ignored; nodes without edges don't
    appear. The rounds grow with the square of the logarithm of the longest
    chain at most; each writes its edges to the shared folder, and the driver sees only a
    count and a checksum. Aggregates combine before their shuffle and the joins
    may be split, so that a node with very many edges is no bottleneck.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    now = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark, old = None, None
    for _ in range(ROUNDS):
        path = new_folder(spark, "stars")
        (now if mark is None else _small_star(_large_star(now))).write.parquet(path)
        now = spark.read.schema(ends.schema).parquet(path)
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if old:
            remove(spark, old)
        if seen[0] == 0 or seen == mark:
            break
        mark, old = seen, path
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
