"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, scratch_path


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (src, dst, both long): root is the
    smallest node that can be reached. An empty edge table gives an empty result.

    Each round turns every node's larger neighbours to its smallest neighbour
    (large star), then every node's smaller ones and itself (small star); the number
    of rounds grows with the logarithm of a component's width. The minimum per node
    is pre-aggregated before its shuffle, and a node with very many edges is one key
    of a join whose other side has one row for it, which adaptive execution splits.
    Rounds are written to the shared checkpoint folder; the driver sees two sums.
    """
    spark = edges.sparkSession
    one = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")
    )
    path = scratch_path(spark, "edges")
    now = cut(one.distinct(), "edges", path)
    before = _digest(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct()
        older, path = path, scratch_path(spark, "edges")
        now = cut(small, "edges", path)
        remove(spark, older)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"] or 0
