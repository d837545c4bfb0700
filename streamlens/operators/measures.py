"""Operational and quality measures: ranking metrics, confusion, sweeps, rates, learning signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions.structures import upper_median


def ranking_metrics(first_rank: DataFrame, rank: str = "rank", latency: str | None = None) -> DataFrame:
    """One row: cases, top-1/3/5 shares, mean reciprocal rank within 10, and mean and nearest-rank p95 of a latency.

    first_rank: a row per case with the rank of its first relevant result, or null.
    """
    r = F.col(rank)
    share = lambda n: F.avg(F.coalesce((r <= n).cast("double"), F.lit(0.0)))
    out = [F.count("*").alias("cases"), share(1).alias("top1"), share(3).alias("top3"), share(5).alias("top5"), F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)).alias("mrr")]
    if latency:
        out.append(F.avg(latency).alias("mean_latency"))
        return first_rank.agg(*out).join(F.broadcast(nearest_rank_of(first_rank, latency, 0.95).withColumnRenamed("value", "p95_latency")), F.lit(True))
    return first_rank.agg(*out)


def running_counts(counts: DataFrame, order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """counts with <column>_before: the sum over rows of smaller order. Rows are dealt into ranges of order; sums inside a range are windows over it, sums of the ranges before come
    from one row a range, so no task orders all rows."""
    dealt = counts.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id())
    totals = dealt.groupBy("__part").agg(F.min(order).alias("__from"), *[F.sum(c).alias(f"__{c}") for c in columns])
    before = W.orderBy("__from").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("__from", F.lead("__from").over(W.orderBy("__from")).alias("__to"), *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    x = counts.join(F.broadcast(starts), (F.col(order) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(order) < F.col("__to"))))
    inside = W.partitionBy("__from").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return x.select(*counts.columns, *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in columns])


def nearest_rank_of(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the ceil(share * n)-th smallest value (from 1), from the counts of distinct values."""
    by = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("__all"))
    at = running_counts(by, "value", ["n"]).join(F.broadcast(total), F.lit(True))
    return at.where(F.col("n_before") + F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("__all") * F.lit(share)))).agg(F.min("value").alias("value"))


def confusion(df: DataFrame, keys: list[str], positive: Column, predicted: Column) -> DataFrame:
    x = [F.count_if(predicted & positive).alias("tp"), F.count_if(predicted & ~positive).alias("fp"), F.count_if(~predicted & positive).alias("fn"), F.count_if(~predicted & ~positive).alias("tn")]
    return df.groupBy(*keys).agg(*x)


def threshold_sweep(df: DataFrame, score: str, positive: Column, loss_cap: float) -> DataFrame:
    """The threshold that removes most negatives (score below it) while losing at most loss_cap of the positives; higher wins ties.

    Counts per distinct score are summed first, then added up range by range.
    """
    by = df.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    total = by.agg(F.sum("p").alias("positives"))
    at = running_counts(by, score, ["p", "n"]).join(F.broadcast(total), F.lit(True)).select(F.col(score).alias("threshold"), F.col("p_before").alias("lost"), F.col("n_before").alias("removed"), "positives")
    ok = at.where(F.col("lost") <= loss_cap * F.col("positives"))
    return ok.agg(F.max(F.struct("removed", "threshold", "lost")).alias("b")).select("b.threshold", "b.removed", "b.lost")


def stage_rates(runs: DataFrame, job: str, finished: str, phases: str, length: Column, last: int = 8) -> DataFrame:
    """phase and the upper median of seconds per second of recording over the latest jobs. phases: map of phase to seconds."""
    recent = runs.orderBy(F.desc(finished), F.desc(job)).limit(last)
    x = recent.select(F.explode(phases).alias("phase", "seconds"), length.alias("length")).where("length > 0 AND seconds >= 0")
    return x.groupBy("phase").agg(upper_median(F.collect_list(F.col("seconds") / F.col("length"))).alias("rate"), F.count("*").alias("n"))


def unequal_pairs(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Pairs of rows with unequal labels of each key, from counts: (n^2 - sum of n_l^2) / 2."""
    by = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return by.groupBy(*keys).agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("pairs"))


def streaks(days: DataFrame, keys: list[str], day: str, hit: Column) -> DataFrame:
    """Longest and current run of days with a hit, days in order; current counts back from the last."""
    w = W.partitionBy(*keys).orderBy(day)
    x = days.withColumn("__h", F.coalesce(hit, F.lit(False))).withColumn("__g", F.sum((~F.col("__h")).cast("int")).over(w))
    runs = x.groupBy(*keys, "__g").agg(F.count_if(F.col("__h")).alias("n"), F.max(day).alias("__last"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"), F.max_by("n", "__last").alias("current"))


def smoothed_signal(df: DataFrame, keys: list[str], positive: Column, negative: Column) -> DataFrame:
    """Ratios of events per key that grow with their number: a / sqrt(i + 1), a / (i + 5), net / (n + 4)."""
    x = df.groupBy(*keys).agg(F.count_if(positive).alias("a"), F.count_if(negative).alias("b"), F.count("*").alias("n"))
    return x.select(*keys, (F.col("a") / F.sqrt(F.col("n") + 1)).alias("interest"), (F.col("a") / (F.col("n") + 5)).alias("rate"), ((F.col("a") - F.col("b")) / (F.col("n") + 4)).alias("net"))


def trajectory(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Statistics of a channel over a window: mean, spread, maximum, means of thirds, the last's ratio to the first's, slope, place of the maximum, share above the 80th percentile."""
    w = W.partitionBy(*keys)
    x = df.withColumn("__i", F.row_number().over(w.orderBy(t)) - 1).withColumn("__n", F.count("*").over(w)).withColumn("__q", F.percentile(value, 0.8).over(w))
    third = F.floor(F.col("__i") * 3 / F.col("__n"))
    mean = lambda k: F.avg(F.when(third == k, F.col(value)))
    return x.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"), F.max(value).alias("top"), mean(0).alias("first"), mean(1).alias("middle"), mean(2).alias("last"), (mean(2) / F.greatest(mean(0), F.lit(1e-6))).alias("ratio"),
        F.coalesce(F.regr_slope(value, "__i"), F.lit(0.0)).alias("slope"), (F.max_by("__i", F.struct(F.col(value), -F.col("__i"))) / F.greatest(F.lit(1), F.max("__n") - 1)).alias("peak_place"),
        F.avg((F.col(value) > F.col("__q")).cast("double")).alias("share_high"),
    )
