"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces a node's edges by edges to its smallest neighbour, found by an aggregate that
is combined before its shuffle; the joins back are on a node, and adaptive execution splits
a hub's rows. Edges never grow in number. Every round is written to the shared folder, so lineage stays
short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.store import materialize


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over distinct edges with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    joined = large.join(least, F.col("a") == F.col("n"))
    small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the smallest node of its component) for every node that has an edge.

    edges: long columns a and b; direction, loops and repetitions do not matter.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        now = materialize(_star(now), name)
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
