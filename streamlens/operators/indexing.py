"""The library's index as a table by kind and shard of sources: composing its texts, and rebuilding some kinds of some sources in place.

A refresh reads only the partitions of its kinds and of its sources' shards, writes what they hold afterwards to a staging table, and swaps the partitions by dynamic
partition overwrite; other kinds and shards are not touched. Every refreshed source leaves a mark per kind with its revision, so that a partition is
replaced even when nothing is left in it, and that later runs know what is up to date. Applying a staged refresh again, after a failure or by mistake, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.operators.intervals import range_join
from streamlens.shared import written

#: Shards of sources of each kind; a refresh rewrites whole shards.
SHARDS = 64
_MARK = {"mark": "boolean", "revision": "string", "status": "string", "retry_at": "double"}


def shard(source: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(source.cast("string")), F.lit(shards)).cast("int")


def composed(lines: DataFrame, clips: DataFrame, keys: list[str], reach: int = 2, pad: float = 8.0, bucket: float = 60.0) -> DataFrame:
    """keys, id, kind, text and revision (a digest of kind and text) of what the index encodes: a line with the lines around it by position, a clip with its title, its text and
    what is spoken from pad before to pad after it. lines: keys, id, start, end, text; clips: keys, id, start, end, title, text."""
    around = W.partitionBy(*keys).orderBy("start", "id").rowsBetween(-reach, reach)
    said = F.transform(F.array_sort(F.collect_list(F.struct("start", "id", "text")).over(around)), lambda x: x["text"])
    spoken = lines.select(*keys, "id", F.lit("transcript").alias("kind"), F.array_join(said, " ").alias("text"))
    near = range_join(clips.select(*keys, F.col("id").alias("clip"), "start", "end"), lines.select(*keys, F.col("id").alias("line"), F.col("start").alias("l_start"), F.col("end").alias("l_end"), F.col("text").alias("said")), keys, ("start", "end"), ("l_start", "l_end"), pad, bucket)
    words = near.groupBy(F.col("clip").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_start", "line", "said"))), lambda x: x["said"]), " ").alias("words"))
    full = F.array_join(F.filter(F.array("title", "text", "words"), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    shown = clips.join(words, "id", "left").select(*keys, "id", F.lit("clip").alias("kind"), full.alias("text"))
    return spoken.unionByName(shown).withColumn("revision", F.sha2(F.concat_ws("|", "kind", "text"), 256))


def source_revisions(entries: DataFrame, source: str = "source") -> DataFrame:
    """source and revision: a mark of all its rows that does not depend on their order."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", "id", "kind", "text"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return entries.groupBy(source).agg(F.concat_ws("-", F.count("*"), F.sum(row)).alias("revision"))


def build(entries: DataFrame, path: str, shards: int = SHARDS, revisions: DataFrame | None = None) -> None:
    """Writes the whole index anew. entries: source, kind and any other columns; revisions: source and revision, for the marks."""
    rows = _rows(entries, shards)
    rows = rows if revisions is None else rows.unionByName(_marks(revisions, [r.kind for r in entries.select("kind").distinct().collect()], shards), allowMissingColumns=True)
    rows.repartition("kind", "shard").write.partitionBy("kind", "shard").mode("overwrite").parquet(path)


def _rows(entries: DataFrame, shards: int) -> DataFrame:
    return entries.withColumn("shard", shard(F.col("source"), shards)).withColumns({c: F.lit(False if c == "mark" else None).cast(k) for c, k in _MARK.items() if c not in entries.columns})


def _marks(sources: DataFrame, kinds: list[str], shards: int) -> DataFrame:
    given = {c: F.col(c) if c in sources.columns else F.lit("ready" if c == "status" else None) for c in ("revision", "status", "retry_at")}
    x = sources.select("source", *[c.cast(_MARK[n]).alias(n) for n, c in given.items()], F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return x.withColumns({"mark": F.lit(True), "shard": shard(F.col("source"), shards)})


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumns({"shard": F.col("shard").cast("int"), "kind": F.col("kind").cast("string")})


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The index's rows, without marks."""
    return _table(spark, path).where("NOT mark").drop("shard", *_MARK)


def marks(spark: SparkSession, path: str) -> DataFrame:
    """source, kind, revision, status and retry_at of what was refreshed."""
    return _table(spark, path).where("mark").select("source", "kind", "revision", "status", "retry_at")


def staged(path: str, fresh: DataFrame, sources: DataFrame, kinds: list[str], shards: int = SHARDS, keep: DataFrame | None = None) -> DataFrame:
    """What the partitions of a refresh hold afterwards, written: rows of other sources, fresh rows of these, and their marks.

    sources: source and, where known, revision, status and retry_at. Those in keep are marked but keep the rows they have (a rebuild of theirs failed).
    """
    spark = fresh.sparkSession
    s = written(sources, "sources")
    hit = [r[0] for r in s.select(shard(F.col("source"), shards)).distinct().collect()]  # at most as many numbers as there are shards
    now = _table(spark, path).where(F.col("kind").isin(kinds) & F.col("shard").isin(hit))
    gone = s.select("source") if keep is None else s.select("source").join(keep.select("source"), "source", "left_anti")
    others = now.where("NOT mark").join(gone, "source", "left_anti").unionByName(now.where("mark").join(s.select("source"), "source", "left_anti"))
    new = _rows(fresh.where(F.col("kind").isin(kinds)).join(gone, "source", "left_semi"), shards)
    return written(others.unionByName(new, allowMissingColumns=True).unionByName(_marks(s, kinds, shards), allowMissingColumns=True), "staged")


def applied(stage: DataFrame, path: str) -> None:
    """Swaps the partitions that the staged table holds; may be repeated."""
    stage.repartition("kind", "shard").write.partitionBy("kind", "shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def refresh(path: str, fresh: DataFrame, sources: DataFrame, kinds: list[str], shards: int = SHARDS, keep: DataFrame | None = None) -> None:
    """Rebuilds the rows of sources of the given kinds from fresh; rows of other kinds stay as they are."""
    applied(staged(path, fresh, sources, kinds, shards, keep), path)


def outdated(spark: SparkSession, path: str, wanted: DataFrame, kinds: list[str], now: float) -> DataFrame:
    """wanted sources (source, revision) that the index does not hold at that revision in all kinds, and those that failed and may be tried again. A failed one is left alone until then."""
    m = marks(spark, path).where(F.col("kind").isin(kinds)).groupBy("source").agg(F.min("revision").alias("least"), F.max("revision").alias("most"), F.count("*").alias("n"), F.max(F.col("status") == "failed").alias("failed"), F.max("retry_at").alias("retry_at"))
    x = wanted.join(m, "source", "left")
    ready = F.coalesce(~F.col("failed") & (F.col("n") == len(kinds)) & (F.col("least") == F.col("revision")) & (F.col("most") == F.col("revision")), F.lit(False))
    waits = F.coalesce(F.col("failed") & (F.col("retry_at") > now), F.lit(False))
    return x.where(~ready & ~waits).select("source", "revision")
