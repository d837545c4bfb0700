"""Per-second tracks: dense histograms, alignment, overlays, smoothing, binning, downsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spine(bounds: DataFrame, keys: list[str], first: str, last: str, out: str = "t") -> DataFrame:
    """One row for every whole step from first to last of each key."""
    return bounds.select(*keys, F.explode(F.sequence(F.col(first).cast("long"), F.col(last).cast("long"))).alias(out))


def dense_histogram(df: DataFrame, keys: list[str], t: Column, bounds: DataFrame, first: str, last: str, **aggregates: Column) -> DataFrame:
    """Aggregates per whole step over the bounds, 0 where there are no rows; rows outside are dropped."""
    sums = df.groupBy(*keys, F.floor(t).cast("long").alias("t")).agg(*[c.alias(n) for n, c in aggregates.items()])
    out = spine(bounds, keys, first, last).join(sums, [*keys, "t"], "left")
    return out.fillna(0, subset=list(aggregates))


def align(timeline: DataFrame, keys: list[str], t: str, tracks: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Tracks joined to a timeline by rounded time. tracks: name -> (rows, time, value, order); of several rows in a second the last by order counts; missing is 0."""
    out = timeline.withColumn("__s", F.bround(t).cast("long"))
    for name, (rows, rt, value, order) in tracks.items():
        one = rows.groupBy(*keys, F.bround(rt).cast("long").alias("__s")).agg(F.max_by(value, order).alias(name))
        out = out.join(one, [*keys, "__s"], "left").fillna(0.0, subset=[name])
    return out.drop("__s")


def overlay(base: DataFrame, refined: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Refined rows replace base rows of the same keys; new ones are added."""
    r = refined.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__has"))
    return base.join(r, keys, "full_outer").select(*keys, *[F.when(F.col("__has"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values])


def moving_average(df: DataFrame, keys: list[str], t: str, value: str, width: int, out: str) -> DataFrame:
    """Centred mean over width rows (an even width grows by one); fewer at the edges."""
    half = (width + 1 - width % 2) // 2
    return df.withColumn(out, F.avg(value).over(W.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)))


def dilate(df: DataFrame, keys: list[str], t: str, value: str, reach: int, out: str) -> DataFrame:
    """Largest value within reach rows on both sides."""
    return df.withColumn(out, F.max(value).over(W.partitionBy(*keys).orderBy(t).rowsBetween(-reach, reach)))


def rise_over_median(df: DataFrame, keys: list[str], t: str, value: str, rows: int, out: str, present: Column | None = None) -> DataFrame:
    """Value minus the median of the rows before it (only present ones), not below 0; 0 without any."""
    x = F.col(value) if present is None else F.when(present, F.col(value))
    base = F.percentile(x, 0.5).over(W.partitionBy(*keys).orderBy(t).rowsBetween(-rows, -1))
    return df.withColumn(out, F.coalesce(F.greatest(F.lit(0.0), x - base), F.lit(0.0)))


def trailing_z(df: DataFrame, keys: list[str], t: str, value: str, rows: int, floor: float, top: float, out: str) -> DataFrame:
    """Robust score against the median and MAD of the last rows including this one."""
    frame = F.collect_list(F.col(value).cast("double")).over(W.partitionBy(*keys).orderBy(t).rowsBetween(1 - rows, 0))

    def median(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2

    df = df.withColumn("__f", frame).withColumn("__m", median(F.col("__f")))
    df = df.withColumn("__d", median(F.transform("__f", lambda v: F.abs(v - F.col("__m")))))
    z = (F.col(value) - F.col("__m")) / F.greatest(F.col("__d") * 1.4826, F.lit(floor))
    return df.withColumn(out, F.least(F.greatest(z, F.lit(0.0)), F.lit(top))).drop("__f", "__m", "__d")


def box_mean(df: DataFrame, keys: list[str], t: str, value: str, low: int, high: int, out: str) -> DataFrame:
    """Mean over the offsets low..high, where offsets beyond an end repeat the end's value."""
    w = W.partitionBy(*keys).orderBy(t)
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, i = F.count("*").over(every), F.row_number().over(w)
    inside = F.coalesce(F.sum(value).over(w.rowsBetween(low, high)), F.lit(0.0))
    before = F.least(F.lit(high - low + 1), F.greatest(F.lit(0), 1 - (i + low)))
    after = F.least(F.lit(high - low + 1), F.greatest(F.lit(0), i + high - n))
    total = inside + before * F.first(value).over(every) + after * F.last(value).over(every)
    return df.withColumn(out, total / (high - low + 1))


def bins(df: DataFrame, keys: list[str], t: Column, width: float, count: int, **aggregates: Column) -> DataFrame:
    """Aggregates over a fixed number of bins; the last is open-ended."""
    return df.groupBy(*keys, F.least(F.lit(count - 1), F.floor(t / width)).cast("int").alias("bin")).agg(*[c.alias(n) for n, c in aggregates.items()])


def downsample_max(df: DataFrame, keys: list[str], t: str, value: str, points: int) -> DataFrame:
    """At most so many points per key: maxima of equal runs of rows, as shares of the key's peak."""
    w = W.partitionBy(*keys)
    d = df.withColumn("__i", F.row_number().over(w.orderBy(t)) - 1).withColumn("__step", F.ceil(F.count("*").over(w) / points))
    d = d.groupBy(*keys, F.floor(F.col("__i") / F.col("__step")).alias("point")).agg(F.min(t).alias(t), F.max(value).alias("peak"))
    top = F.max("peak").over(w)
    return d.withColumn("level", F.when(top > 0, F.col("peak") / top).otherwise(F.lit(0.0)))


def percentile_rank(df: DataFrame, keys: list[str], value: str, position: str, out: str) -> DataFrame:
    """i / (n - 1) in the order of (value, position); 0 for a single row."""
    w = W.partitionBy(*keys)
    n = F.count("*").over(w)
    return df.withColumn(out, F.when(n > 1, (F.row_number().over(w.orderBy(value, position)) - 1) / (n - 1)).otherwise(F.lit(0.0)))


def min_max(df: DataFrame, keys: list[str], value: str, low: float, high: float, out: str) -> DataFrame:
    """Scaled to low..high within each key; a flat key has the middle, a single row the top."""
    w = W.partitionBy(*keys)
    lo, hi, n = F.min(value).over(w), F.max(value).over(w), F.count("*").over(w)
    return df.withColumn(out, F.when(n == 1, F.lit(high)).when(hi == lo, F.lit((low + high) / 2)).otherwise(low + (high - low) * (F.col(value) - lo) / (hi - lo)))
