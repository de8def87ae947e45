"""Connected components of a graph given by pairs, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.scratch import discard, materialise


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``edges`` (columns a, b of one type).

    Alternates two steps until nothing moves: every node hands its smallest
    neighbour to the larger ones, then to the smaller ones. Only minima are
    grouped, so a node with very many edges is summed before the shuffle, and
    the joins may split it. Every round is stored in the shared folder; the
    driver sees two numbers a round. No edges give no rows.
    """
    spark = edges.sparkSession
    current = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        first = materialise(larger.distinct(), label)
        lowest = first.groupBy("a").agg(F.min("b").alias("m"))
        smaller = first.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        following = materialise(smaller.union(lowest.select("a", F.col("m").alias("b"))).distinct(), label)
        discard(spark, current)
        discard(spark, first)
        current, before = following, mark
        mark = _mark(current)
        if mark == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    hashed = F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))
    return tuple(edges.agg(F.count(F.lit(1)), hashed).first())
