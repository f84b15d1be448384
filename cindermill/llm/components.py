"""Connected components of an edge table by alternating large-star and small-star rounds; each round is written to the shared folder.

The node that many others hang on is a hot key of every round. Its least neighbour is found by a combined aggregate;
the join that brings it to all edges is keyed so that both sides come straight from a shuffle of their own, which lets
Spark split the hot key among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, split_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return split_join(both.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = split_join(down, least, ["a"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, label: str = "components", owner: Scratch | None = None) -> DataFrame:
    """``edges`` (a, b) to (node, component): component is the smallest node that can be reached; nodes that are the smallest of theirs are not listed.

    The result is a hand-over; it goes with those of ``owner``, if given. Rounds end when their number of edges and the
    sum of their hashes stay the same.
    """
    scratch = Scratch(edges.sparkSession)

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = scratch(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), label)
        scratch.clear(leave=1)
        return out, (seen.get["n"], seen.get["s"])

    current, state = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while state[0]:
        before = state
        current, state = written(_small_star(_large_star(current)))
        if state == before:
            break
    if owner:
        owner.paths += scratch.paths
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
