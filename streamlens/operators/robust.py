"""Median and MAD per group, robust scores and thresholds (exact percentiles, two aggregates); means added in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions.scoring import MAD_SCALE, robust_z, saturate


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median and mad of value; nulls do not count."""
    mid = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    spread = df.join(mid, keys).groupBy(*keys, "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    return spread.select(*keys, "median", "mad")


def with_robust_z(df: DataFrame, keys: list[str], value: str, out: str = "z") -> DataFrame:
    stats = median_mad(df, keys, value)
    return df.join(stats, keys).withColumn(out, robust_z(F.col(value), F.col("median"), F.col("mad"))).drop("median", "mad")


def with_saturation(df: DataFrame, keys: list[str], value: str, out: str = "level") -> DataFrame:
    return with_robust_z(df, keys, value, out).withColumn(out, saturate(F.col(out)))


def with_saturations(df: DataFrame, keys: list[str], outs: dict[str, str]) -> DataFrame:
    """with_saturation for several columns (value: out). Rows are dealt by their keys once, however many columns there are: joins with one column's
    statistics after another would meet in one stage, whose sorts outgrow a task's memory. Rows without a key drop out, as in a join."""
    w = W.partitionBy(*keys)
    x = df.dropna(subset=keys).withColumns({f"__median_{out}": F.percentile(value, 0.5).over(w) for value, out in outs.items()})
    x = x.withColumns({f"__mad_{out}": F.percentile(F.abs(F.col(value) - F.col(f"__median_{out}")), 0.5).over(w) for value, out in outs.items()})
    levels = {out: saturate(robust_z(F.col(value), F.col(f"__median_{out}"), F.col(f"__mad_{out}"))) for value, out in outs.items()}
    return x.withColumns(levels).drop(*[f"__{s}_{out}" for s in ("median", "mad") for out in outs.values()])


def thresholds(df: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """keys and theta = median + k * 1.4826 * MAD."""
    return median_mad(df, keys, value).select(*keys, (F.col("median") + k * MAD_SCALE * F.col("mad")).alias("theta"))


def spikes(df: DataFrame, keys: list[str], value: str, limit: float = 2.5, share: float = 0.05) -> DataFrame:
    """Rows whose deviation over max(1.4826 MAD, share * median, 1e-6) exceeds limit."""
    stats = median_mad(df, keys, value)
    scale = F.greatest(F.col("mad") * MAD_SCALE, F.abs(F.col("median")) * share, F.lit(1e-6))
    return df.join(stats, keys).withColumn("z", (F.col(value) - F.col("median")) / scale).where(F.col("z") > limit).drop("median", "mad")


def ordered_means(df: DataFrame, keys: list[str], order: list[str], columns: list[str], *others: Column) -> DataFrame:
    """keys, the means of columns, and other aggregates. Numbers are added in the given order: what is held against a bar that a mean may meet exactly must not
    depend on the order in which rows arrive."""
    w = W.partitionBy(*keys).orderBy(*order)
    held = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    x = df.withColumns({"__n": F.row_number().over(w), **{f"__mean_{c}": F.avg(c).over(held) for c in columns}})
    return x.groupBy(*keys).agg(*[F.max_by(f"__mean_{c}", "__n").alias(c) for c in columns], *others)
