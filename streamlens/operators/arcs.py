"""Arcs of a curve: runs above a threshold, widened to where the curve falls to the onset threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.operators.robust import median_mad


def find_arcs(curve: DataFrame, keys: list[str], t: str, value: str, k: float = 2.0, onset_k: float = 0.5) -> DataFrame:
    """keys, start, end, peak_time, peak_value, n_rows and auc of every arc.

    An arc is a run of rows above median + k * 1.4826 * MAD; its ends move outwards over rows that are above the
    onset threshold. Neighbouring arcs may overlap after that.
    """
    stats = median_mad(curve, keys, value).select(*keys, (F.col("median") + k * 1.4826 * F.col("mad")).alias("theta"), (F.col("median") + onset_k * 1.4826 * F.col("mad")).alias("onset"))
    w = W.partitionBy(*keys).orderBy(t)
    c = curve.join(stats, keys)
    quiet = F.when(F.col(value) <= F.col("onset"), F.col(t))
    first, last = F.min(t).over(W.partitionBy(*keys)), F.max(t).over(W.partitionBy(*keys))
    c = c.withColumn("__before", F.last(quiet, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    c = c.withColumn("__after", F.first(quiet, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    c = c.withColumn("__lo", F.coalesce("__before", first)).withColumn("__hi", F.coalesce("__after", last))
    c = c.withColumn("__m", F.col(value) > F.col("theta"))
    c = c.withColumn("__run", F.sum((F.col("__m") != F.coalesce(F.lag("__m").over(w), F.lit(False))).cast("int")).over(w)).where("__m")
    peak = F.max(F.struct(F.col(value).alias("v"), (-F.col(t)).alias("t")))
    return (
        c.groupBy(*keys, "__run")
        .agg(F.min("__lo").alias("start"), F.max("__hi").alias("end"), peak.alias("p"), F.count("*").alias("n_rows"), F.sum(value).alias("auc"))
        .select(*keys, "start", "end", (-F.col("p.t")).alias("peak_time"), F.col("p.v").alias("peak_value"), "n_rows", "auc")
    )
