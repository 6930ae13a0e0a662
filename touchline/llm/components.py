"""Connected components of links between longs, without the driver or one task seeing them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_dir, written


def _smallest(links: DataFrame) -> DataFrame:
    """links (a, b) with m, the smallest of a and all b linked to it."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").withColumn("m", F.least("a", "m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (a, b) but the roots; root is the smallest node reachable.

    Large-star and small-star steps in turn: each links the neighbours of a node to the smallest of them.
    A node with very many neighbours is a skewed join key, which adaptive execution splits; the minima are
    aggregated partially. Every round is written, so a lost executor costs one round at most.
    """
    spark, work = links.sparkSession, work_dir(links.sparkSession)
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{work}/links")
    before = None
    for k in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        ordered = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = _smallest(ordered)
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), f"{work}/round{k}")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"links did not settle in {rounds} rounds")
