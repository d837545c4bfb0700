"""Keeping the index up to date from a log of changed sources: micro-batches, each for the sources whose revision differs from the index's mark."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.operators import indexing
from streamlens.shared import written

#: Takes sources (source, revision); gives their rows, and the sources (source) that could not be built.
Rebuild = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def maintain(changes: DataFrame, index: str, kinds: list[str], rebuild: Rebuild, checkpoint: str, shards: int = indexing.SHARDS, retry_seconds: float = 300.0, clock: Callable[[], float] = time.time):
    """Runs over all changes that are there (source, revision, at; a stream) and stops; gives the streaming query.

    A batch rebuilds the newest revision of each of its sources, and of sources that failed before and are due, if the index does not hold it yet. The revision marks are part of the partitions
    that the refresh swaps, so a batch that is run again after a crash finds its work done and does none of it twice. A failed source keeps its rows and is tried
    again with the first batch after retry_seconds.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark, now = rows.sparkSession, clock()
        newest = rows.groupBy("source").agg(F.max_by("revision", "at").alias("revision"))
        due = indexing.marks(spark, index).where((F.col("status") == "failed") & (F.col("retry_at") <= now)).groupBy("source").agg(F.max("revision").alias("revision"))
        wanted = newest.unionByName(due.join(newest, "source", "left_anti"))
        stale = written(indexing.outdated(spark, index, wanted, kinds, now), f"stale-{batch_id}")
        if stale.isEmpty():
            return
        fresh, failed = rebuild(stale)
        failed = written(failed.select("source").distinct(), f"failed-{batch_id}").withColumn("__failed", F.lit(True))
        over = F.coalesce("__failed", F.lit(False))
        marked = stale.join(failed, "source", "left").select("source", "revision", F.when(over, "failed").otherwise("ready").alias("status"), F.when(over, F.lit(now + retry_seconds)).alias("retry_at"))
        indexing.refresh(index, fresh, marked, kinds, shards, keep=failed)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
