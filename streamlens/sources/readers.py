"""Readers of the library's files: versioned JSON envelopes, chat replays, transcripts, subtitles, WAV audio.

All go through Spark's readers with a schema, so any Hadoop file system works and nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens import schemas
from streamlens.operators import intervals


def read_envelope(spark: SparkSession, path: str, record: str, kind: str, version: int) -> DataFrame:
    """Records of gzip JSON files {format, version, records: [...]}; files of another format or version, or malformed, give none."""
    text = f"format string, version int, records array<struct<{record}>>"
    files = spark.read.schema(text).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return files.where((F.col("format") == kind) & (F.col("version") == version)).select(F.inline("records"))


def write_envelope(rows: DataFrame, path: str, kind: str, version: int) -> None:
    """One envelope per partition of rows, compressed, each in a file of its own; Spark commits the files together."""
    columns = rows.columns
    grouped = rows.withColumn("__p", F.spark_partition_id()).groupBy("__p").agg(F.collect_list(F.struct(*columns)).alias("records"))
    grouped.select(F.lit(kind).alias("format"), F.lit(version).alias("version"), "records").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 1).json(path)


def read_json_array(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Rows of files that hold one JSON array; what is not an object is skipped."""
    return spark.read.schema(record).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_chat_replay(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """timestamp, text and emotes of chat replays; messages without an offset are dropped. limit: rows to return, by time."""
    files = spark.read.schema(schemas.CHAT_REPLAY).option("multiLine", True).json(path)
    c = files.select(F.explode("comments").alias("c")).select(
        F.col("c.content_offset_seconds").alias("timestamp"), F.coalesce("c.message.body", F.lit("")).alias("text"), F.coalesce(F.size("c.message.emoticons"), F.lit(0)).alias("emotes")
    )
    c = c.where("timestamp IS NOT NULL").withColumn("emotes", F.greatest("emotes", F.lit(0)))
    return c.orderBy("timestamp").limit(limit) if limit else c


def chat_regions(chat: DataFrame, regions: DataFrame) -> DataFrame:
    """Messages inside any [start, end) region, each (millisecond, text) once."""
    hit = intervals.points_in(chat, regions, [], "timestamp", ("start", "end"), closed=False, how="left_semi")
    return hit.withColumn("__ms", F.bround(F.col("timestamp") * 1000).cast("long")).dropDuplicates(["__ms", "text"]).drop("__ms")


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """job_id, start, end and game of chapters, clipped to the recording; empty ones are dropped."""
    x = spark.read.schema(schemas.CHAPTERS).json(path).select("job_id", "duration", F.inline("chapters"))
    x = x.select("job_id", F.greatest("start", F.lit(0.0)).alias("start"), F.least("end", "duration").alias("end"), "game")
    return x.where("end > start")


def transcript_words(spark: SparkSession, path: str) -> DataFrame:
    """job_id, segment, position, word, start and end of every timed word."""
    t = spark.read.schema(schemas.TRANSCRIPT).json(path).select("job_id", F.posexplode("segments").alias("segment", "s"))
    return t.select("job_id", "segment", F.posexplode("s.words").alias("position", "w")).select("job_id", "segment", "position", "w.word", "w.start", "w.end")


def _seconds(text):
    parts = [F.try_element_at(F.split(text, ":"), F.lit(i)).cast("double") for i in (1, 2, 3)]
    return parts[0] * 3600 + parts[1] * 60 + parts[2]


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """file, start, end, style and text of the dialogue lines of ASS files; override tags go, \\N becomes a space."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line LIKE 'Dialogue:%'")
    f = F.split(F.regexp_replace("line", "^Dialogue:\\s*", ""), ",", 10)
    text = F.trim(F.regexp_replace(F.regexp_replace(f[9], r"\{[^}]*\}", ""), r"\\[Nn]", " "))
    return lines.select("file", _seconds(f[1]).alias("start"), _seconds(f[2]).alias("end"), f[3].alias("style"), text.alias("text"))


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in -1..1 of a 16-bit PCM WAV file."""
    import io
    import wave

    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples are read")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
        return w.getframerate(), x.reshape(-1, w.getnchannels()).mean(axis=1)


def wav_windows(spark: SparkSession, path: str, seconds: float = 1.0) -> DataFrame:
    """file, t, rms, peak, zero_crossings and f0 of every window of WAV files; f0 by autocorrelation between 60 and 400 Hz, null when unvoiced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                rate, x = decode_wav(content)
                step = max(1, int(rate * seconds))
                rows = []
                for i in range(0, len(x), step):
                    w = x[i : i + step]
                    rows.append((file, i / rate, float(np.sqrt((w**2).mean())), float(np.abs(w).max()), int((np.diff(np.signbit(w)) != 0).sum()), pitch(w, rate)))
                yield pd.DataFrame(rows, columns=["file", "t", "rms", "peak", "zero_crossings", "f0"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, t double, rms double, peak double, zero_crossings int, f0 double")


def pitch(x: np.ndarray, rate: int, low: float = 60.0, high: float = 400.0, clarity: float = 0.3) -> float | None:
    """Pitch of a window from the highest autocorrelation between two lags; null if it is not clear."""
    x = x - x.mean()
    n = len(x)
    first, last = int(rate / high), min(int(rate / low), n - 1)
    if n < 4 or last <= first or not (x**2).sum():
        return None
    spectrum = np.fft.rfft(x, 2 * n)
    corr = np.fft.irfft(spectrum * np.conj(spectrum))[:n]
    lag = first + int(np.argmax(corr[first : last + 1]))
    return float(rate / lag) if corr[lag] / corr[0] >= clarity else None
