"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = edges.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) of every node that has an edge and is not its own root.

    ``edges`` has columns a and b of one integer type, in any order, repeats and loops allowed. No neighbour list is
    collected: a node with very many neighbours is rows of joins and partial aggregates. Each round is written to
    the shared folder and cuts the lineage; rounds grow with the logarithm of the longest path.
    """
    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, a))")).first())

    current = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round-0")
    seen, k = mark(current), 0
    while seen[0]:
        k += 1
        following = scratch.write(_small_star(_large_star(current)), f"round-{k}")
        now = mark(following)
        scratch.drop(f"round-{k - 1}")
        current = following
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
