"""Exact deduplication with a heavy-hitter split, in DataFrame and SQL functions only.

Texts are equal when they are identical after lower-casing A-Z; their key is the SHA-256 digest of that
form. Digests that hold more than SHARE of all rows are found with Misra-Gries counters (Spark's
approx_top_k summaries, the batched variant of that algorithm): one summary per task, merged by groups
of tasks and then together, so that no step sees more than bounded summaries. The candidates are counted
exactly against the whole table; at most 1 / SHARE digests can pass, so the table of winners
is broadcast, and all rows of these digests are resolved where they are read, without a shuffle.
The remaining digests, each with at most SHARE of the rows, go through an ordinary aggregation
and a join by digest, both of which carry digests and ids but no texts.

TRACKED counters miss no digest above SHARE: a summary is off by at most 3.5 / 16384 of the rows, and lists all
digests above twice that, 0.043 %, which is less than SHARE.

Defined cases: a null text is empty; a null doc_id is smaller than any other; of rows
equal in text and doc_id exactly one stays (the one written last); very long texts are digested where
they are read; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.llm.store import free_name, materialize

#: Digests with more than this share of all rows are resolved by broadcast.
SHARE = 1e-3
#: Counters of a Misra-Gries summary.
TRACKED = 10_000
#: Groups of tasks whose summaries are merged before the last merge.
MERGES = 128


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def frequent(rows: DataFrame, key: str, share: float = SHARE, tracked: int = TRACKED) -> DataFrame:
    """Candidates (column key): every value that more than share of the rows hold, and possibly others; at most 2 / share of them."""
    if 7 / (1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))) >= share:
        raise ValueError(f"{tracked} counters cannot find every value above a share of {share}")
    most = min(tracked, math.ceil(2 / share))
    task = F.pmod(F.spark_partition_id(), F.lit(MERGES))
    summaries = rows.groupBy(task.alias("merge")).agg(F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("summary"))
    together = summaries.groupBy(F.lit(0).alias("all")).agg(F.expr("approx_top_k_combine(summary)").alias("summary"))  # grouped, so that no task combines nothing
    return together.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {most})")).alias("found")).select(F.col("found.item").alias(key))


def _winners(rows: DataFrame, key: str, order: Column, share: float, tracked: int) -> DataFrame:
    """Exact counts and the last row of every key with more than share of the rows: at most 1 / share rows, written."""
    total = rows.count()
    counted = rows.join(F.broadcast(frequent(rows, key, share, tracked)), key).groupBy(key).agg(F.max(order).alias("last"), F.count("*").alias("size"))
    return materialize(counted.where((F.col("size") > share * total) & (F.col("size") > 1)), "heavy")


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float = SHARE, tracked: int = TRACKED) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    tagged = docs.select(F.col(id_column).alias("doc_id"), digest(F.col(text_column)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows, order = materialize(tagged, "digests"), F.struct("doc_id", "row")
    marked = rows.join(F.broadcast(_winners(rows, "digest", order, share, tracked)), "digest", "left")
    rest = marked.where(F.col("size").isNull()).select("digest", "doc_id", "row")
    shuffled = rest.join(rest.groupBy("digest").agg(F.max(order).alias("last"), F.count("*").alias("size")), "digest")
    return (
        marked.where(F.col("size").isNotNull())
        .unionByName(shuffled)
        .select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("last.row")).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float = SHARE, tracked: int = TRACKED) -> DataFrame:
    """The rows that stay, with all columns of docs. Copies of heavy texts are removed where they are read; only the rest is shuffled."""
    row, key = free_name(docs.columns, "row"), free_name(docs.columns, "digest")
    tagged = materialize(docs.withColumns({key: digest(F.col(text_column)), row: F.monotonically_increasing_id()}), "tagged")
    keys = tagged.select(F.col(id_column).alias("doc_id"), F.col(key).alias("digest"), F.col(row).alias("row"))
    order = F.struct("doc_id", "row")
    heavy = _winners(keys, "digest", order, share, tracked)
    light = keys.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").groupBy("digest").agg(F.max(order).alias("last"))
    first = tagged.join(F.broadcast(heavy.select(F.col("last.row").alias(row))), row, "left_semi")
    rest = tagged.join(F.broadcast(heavy.select(F.col("digest").alias(key))), key, "left_anti").join(light.select(F.col("last.row").alias(row)), row, "left_semi")
    return first.select(*docs.columns).unionByName(rest.select(*docs.columns))
