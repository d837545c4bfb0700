"""The corpus operators' queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.llm import exact, licenses, lines, media, middle, mixing, neardup, packing, quality, repeats, sequences, spelling, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.materialise_order(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(_table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.measure(_table(spark, sf_dir, "documents"))
    mixed = mixing.mix(sizes, sizes=sizes)
    times = F.size("mix_shards").cast("long")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * times).alias("taken"))


_OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, source_size, rank, CASE rank % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0 ELSE 1.0 END AS weight, 2.0::DOUBLE * source_size AS ceiling
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source)),
levels AS (
  SELECT *, ceiling / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ceiling / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, least(ceiling, coalesce(weight * (SELECT arg_min(level, (ratio, rank)) FROM levels WHERE level <= ratio), ceiling)) AS target
  FROM levels),
passes AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.base, p.target - p.base * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key) - sum(s.size) OVER (PARTITION BY s.source, s.key) / 2.0::DOUBLE AS middle
  FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), k=20)


_OP10_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64.0::DOUBLE * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


#: Occurrences that op11_spelling takes as slips of the pen: those whose draw this divides.
OP11_NOISE = 97


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), noise=OP11_NOISE)


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(_table(spark, sf_dir, "documents"))


_OP12_SQL = """
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM keyed WINDOW same AS (PARTITION BY text_sha256)
"""


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.fill_in_middle(_table(spark, sf_dir, "documents")).drop("output")


_OP13_SQL = f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 FROM ({middle.statement('documents')})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": _OP8_SQL, "op10_topk": _OP10_SQL, "op12_exact": _OP12_SQL, "op13_middle": _OP13_SQL}
