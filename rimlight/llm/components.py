"""Connected components of a graph given as edges, by alternating large and small stars; every round is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import small, stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex of edges (a, b) that isn't the smallest of its component, whose root is that smallest.

    Rounds grow as the logarithm of the longest path. The minima are written first: they are handed out by a broadcast if
    they are few, else by a join of two shuffled tables, whose hubs can be split.
    """
    edges = stage(edges.select("a", "b").where("a != b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = small(stage(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        down = stage(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        least = small(stage(down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least"))
        tied = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = stage(tied.where("a != b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not closed after {rounds} rounds")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
