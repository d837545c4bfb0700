"""Writers of the library's artifacts: datasets by recording with a manifest, curves, peaks and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.functions.scoring import decibel_byte
from streamlens.functions.times import subtitle_clock


def write_artifacts(datasets: dict[str, DataFrame], path: str, job: str = "job_id") -> None:
    """Each dataset as Parquet partitioned by recording (only written recordings are replaced), and a manifest of rows and columns."""
    spark = next(iter(datasets.values())).sparkSession
    manifest = []
    for name, df in datasets.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(f"{path}/{name}")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        manifest.append(df.groupBy(job).agg(F.count("*").alias("rows")).select(job, F.lit(name).alias("dataset"), "rows", F.lit(kinds).alias("columns"), F.sha2(F.lit(kinds), 256).alias("schema_hash")))
    out = manifest[0]
    for m in manifest[1:]:
        out = out.unionByName(m)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(f"{path}/manifest")
    spark.catalog.clearCache()


def curve_arrays(curve: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """The curve of each key as two parallel arrays in order of time, rounded to 3 and 5 digits."""
    pairs = F.array_sort(F.collect_list(F.struct(F.round(t, 3).alias("t"), F.round(value, 5).alias("v"))))
    return curve.groupBy(*keys).agg(pairs.alias("x")).select(*keys, F.transform("x", lambda p: p["t"]).alias("timeline"), F.transform("x", lambda p: p["v"]).alias("score"))


def peak_bytes(samples: DataFrame, keys: list[str], index: str, value: str, bucket: int) -> DataFrame:
    """Loudest sample of every bucket as a byte over 60 dB; the last bucket may be short."""
    b = samples.groupBy(*keys, F.floor(F.col(index) / bucket).alias("bucket")).agg(F.max(F.abs(F.col(value))).alias("peak"))
    return b.select(*keys, "bucket", decibel_byte(F.col("peak")).alias("level"))


def caption_chunks(words: DataFrame, keys: list[str], max_gap: float = 0.6, max_words: int = 4) -> DataFrame:
    """Timed words as short captions: a new one after a silence or after max_words. keys, chunk, start, end, text."""
    rows = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "word"))).alias("w"))
    kind = "array<struct<start:double,end:double,words:array<string>>>"

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (F.size(acc) > 0) & (w["start"] - last["end"] <= max_gap) & (F.size(last["words"]) < max_words)
        grown = F.struct(last["start"].alias("start"), w["end"].alias("end"), F.concat(last["words"], F.array(w["word"])).alias("words"))
        fresh = F.struct(w["start"].alias("start"), w["end"].alias("end"), F.array(w["word"]).alias("words"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    chunks = rows.select(*keys, F.posexplode(F.aggregate("w", F.array().cast(kind), step)).alias("chunk", "c"))
    return chunks.select(*keys, "chunk", "c.start", "c.end", F.array_join("c.words", " ").alias("text"))


def subtitle_lines(chunks: DataFrame) -> DataFrame:
    """ASS dialogue lines of captions in column value; braces are taken out of texts."""
    text = F.translate("text", "{}", "")
    return chunks.select(*[c for c in chunks.columns if c not in ("start", "end", "text")], F.concat(F.lit("Dialogue: 0,"), subtitle_clock(F.col("start")), F.lit(","), subtitle_clock(F.col("end")), F.lit(",Default,,0,0,0,,"), text).alias("value"))
