"""Live operators on Structured Streaming: logs, coalesced progress, histograms, sessions, chat windows.

Each takes a streaming DataFrame and gives one; sinks and triggers are the caller's. They also run on
batch DataFrames where Spark allows it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """An append-only folder of Parquet files as a stream, with bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to a folder exactly once; runs until what is there has been written."""
    return events.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()


def histogram(events: DataFrame, keys: list[str], t: Column, width: float) -> DataFrame:
    """Counts per bin, for the update mode."""
    return events.groupBy(*keys, F.floor(t / width).alias("bin")).agg(F.count("*").alias("n"))


def chat_windows(chat: DataFrame, ts: str, late: str = "30 seconds", width: str = "15 seconds") -> DataFrame:
    """Counts, emotes and intents of tumbling windows with a watermark."""
    from streamlens.functions.strings import is_clip_intent

    x = chat.withWatermark(ts, late).groupBy("job_id", F.window(ts, width).alias("w"))
    x = x.agg(F.count("*").alias("messages"), F.sum("emotes").alias("emotes"), F.count_if(is_clip_intent(F.col("text"))).alias("intents"))
    return x.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages", "emotes", "intents")


def live_sessions(events: DataFrame, keys: list[str], ts: str, gap: str = "12 seconds", late: str = "30 seconds") -> DataFrame:
    """Session windows with a watermark; rows exactly one gap apart share a session."""
    x = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return x.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Insert-or-ignore on the keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


COALESCED = "job_id string, id bigint, phase string, progress double, high_water double"


def coalesce_progress(events: DataFrame, min_seconds: float = 1.0, min_change: float = 0.01) -> DataFrame:
    """Progress events (job_id, id, at double, event_type, phase, progress) that are worth keeping, with the job's high-water mark.

    State per job: last phase, time and progress kept, and the greatest progress. An event of the same
    phase, less than min_seconds later and less than min_change on, is dropped; other kinds always stay.
    """

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, at, progress, high = state.get if state.exists else (None, -1e18, -1e18, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values("id")
        for r in rows.itertuples(index=False):
            value = 0.0 if r.progress is None or pd.isna(r.progress) else float(r.progress)
            high = max(high, value)
            if r.event_type == "progress" and r.phase == phase and r.at - at < min_seconds and abs(value - progress) < min_change:
                continue
            phase, at, progress = r.phase, float(r.at), value
            out.append((key[0], int(r.id), r.phase, value, high))
        state.update((phase, at, progress, high))
        yield pd.DataFrame(out, columns=["job_id", "id", "phase", "progress", "high_water"])

    return events.groupBy("job_id").applyInPandasWithState(fold, COALESCED, "phase string, at double, progress double, high double", "append", GroupStateTimeout.NoTimeout)


def stalled(positions: DataFrame, worker: str, at: str, now: Column, seconds: float) -> DataFrame:
    """Workers whose last advance is older than so many seconds."""
    return positions.groupBy(worker).agg(F.max(at).alias("last")).where(now - F.col("last") > seconds)


def progress_snapshot(positions: DataFrame, duration: float) -> DataFrame:
    """Coverage, rate and time left over workers (worker, done seconds, elapsed seconds); the slowest worker sets the time left."""
    last = positions.groupBy("worker").agg(F.max("done").alias("done"), F.max("elapsed").alias("elapsed"), F.max("share").alias("share"))
    rate = F.sum("done") / F.greatest(F.max("elapsed"), F.lit(1e-6))
    straggler = F.max((F.col("share") - F.col("done")) / F.greatest(F.col("done") / F.greatest(F.col("elapsed"), F.lit(1e-6)), F.lit(1e-6)))
    return last.agg((F.sum("done") / duration).alias("coverage"), rate.alias("rate"), F.greatest(straggler, (duration - F.sum("done")) / F.greatest(rate, F.lit(1e-6))).alias("seconds_left"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there into a table in memory, and return it."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
