"""Dominant directions of unit vectors: mean directions, trimmed rounds, and shares of near and far ones.

Means are sums of components, combined before the shuffle. A round keeps the given share of a key's vectors by cosine: how many lie at or above each cosine is counted over
cosines rounded to DIGITS, so no task sorts a key's vectors; only rows that tie at the bound are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.operators.search import dot, unit
from streamlens.shared import written

DIGITS = 9


def mean_directions(rows: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """keys and centre: the mean of each key's vectors (of size components) at unit length; a key whose mean is zero, or has no vectors, has none."""
    sums = rows.where(F.size(vector) == size).groupBy(*keys).agg(*[F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"c{i}") for i in range(size)])
    x = sums.select(*keys, F.array(*[f"c{i}" for i in range(size)]).alias("__m"))
    return x.where(dot(F.col("__m"), F.col("__m")) > 0).select(*keys, unit(F.col("__m")).alias("centre"))


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def dominant_directions(rows: DataFrame, keys: list[str], id_: str, vector: str, size: int, rounds: int = 5, share: float = 0.30) -> DataFrame:
    """keys and centre after so many rounds: each takes the mean direction of the share of a key's vectors (one at least) that lie nearest to the centre before; ties by id."""
    x = written(rows.where(F.size(vector) == size).select(*keys, F.col(id_).alias("__id"), unit(F.col(vector)).alias("__v")), "units")
    centre = written(mean_directions(x, keys, "__v", size), "centre")
    for _ in range(rounds):
        near = x.alias("x").join(centre.alias("c"), _same(keys, "x", "c")).select("x.*", F.round(dot(F.col("__v"), F.col("centre")), DIGITS).alias("__cos"))
        counts = near.groupBy(*keys, "__cos").agg(F.count("*").alias("__n"))
        down = W.partitionBy(*keys).orderBy(F.desc("__cos"))
        counts = counts.withColumns({"__to": F.sum("__n").over(down), "__all": F.sum("__n").over(W.partitionBy(*keys))})
        keep = F.greatest(F.lit(1), F.floor(F.col("__all") * share + 1e-9))
        bound = counts.where((F.col("__to") >= keep) & (F.col("__to") - F.col("__n") < keep)).select(*keys, F.col("__cos").alias("__bound"), (keep - (F.col("__to") - F.col("__n"))).alias("__ties"))
        held = near.alias("x").join(bound.alias("c"), _same(keys, "x", "c")).select("x.*", "__bound", "__ties").where(F.col("__cos") >= F.col("__bound"))
        tied = held.where(F.col("__cos") == F.col("__bound")).withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("__id"))).where(F.col("__r") <= F.col("__ties")).drop("__r")
        centre = written(mean_directions(held.where(F.col("__cos") > F.col("__bound")).unionByName(tied), keys, "__v", size), "centre")
    return centre


def shares(rows: DataFrame, keys: list[str], similarity: Column, full: Column, far: float, near: float) -> DataFrame:
    """keys, far and near: of a key's full windows the shares with a similarity under far, and of near or more (0 without full windows)."""
    part = lambda c: F.coalesce(F.avg(F.when(full, c.cast("double"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(part(similarity < far).alias("far"), part(similarity >= near).alias("near"))
