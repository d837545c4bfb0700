"""State of a library as tables: upserts, latest decisions, numbering, retention, increments, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Rows of changes replace those of the same keys; of several changes the newest counts."""
    last = latest(changes, keys, newest)
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def merge_upsert(table: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Upsert column by column: 'new' takes the change if it is not null, 'keep' keeps what is there, 'max' the greater."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in rules])
    pick = {"new": lambda o, n: F.coalesce(n, o), "keep": lambda o, n: F.coalesce(o, n), "max": lambda o, n: F.greatest(o, n)}
    return table.join(new, keys, "full_outer").select(*keys, *[pick[r](F.col(c), F.col(f"__{c}")).alias(c) for c, r in rules.items()])


def patch(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Given columns of existing rows change where the change is not null; no rows are added."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return table.join(new, keys, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore on the keys; of equal new rows one is kept."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def delete_cascade(tables: dict[str, DataFrame], key: str, gone: DataFrame, keep: list[str] = ()) -> dict[str, DataFrame]:
    """Rows of the gone keys leave every table, other than those to keep."""
    return {n: t if n in keep else t.join(gone.select(key).distinct(), key, "left_anti") for n, t in tables.items()}


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest order of each key, by one aggregate."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others]).select(*rows.columns)


def number_missing(rows: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """Append-only numbering: rows without a number go on from the key's greatest, in order."""
    top = F.coalesce(F.max(number).over(W.partitionBy(*keys)), F.lit(0))
    place = F.row_number().over(W.partitionBy(*keys, F.col(number).isNull()).orderBy(*order))
    return rows.withColumn(number, F.coalesce(F.col(number), (top + place).cast("long")))


def presentation_rank(rows: DataFrame, keys: list[str], late: Column, score: Column, start: str, out: str = "rank") -> DataFrame:
    """Rank within the key: late rows last, then higher score, then earlier start."""
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(late.cast("int"), score.desc_nulls_last(), start)))


def keep_newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def evict(rows: DataFrame, keys: list[str], order: list[Column], size: str, cap: float) -> DataFrame:
    """The rows that must go, in order, until the rest is within the cap."""
    total = F.sum(size).over(W.partitionBy(*keys))
    before = F.coalesce(F.sum(size).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__go", total - before > cap).where("__go").drop("__go")


def stale(sources: DataFrame, indexed: DataFrame, key: str, version: str, current: int) -> DataFrame:
    """Keys that are not indexed, or by an older version."""
    done = indexed.where(F.coalesce(F.col(version), F.lit(0)) >= current).select(key)
    return sources.join(done, key, "left_anti")


def changed(rows: DataFrame, known: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows whose content digest is not known under their key."""
    x = rows.withColumn("__d", F.sha2(content, 256))
    return x.join(known.select(F.col(key), F.col("digest").alias("__d")), [key, "__d"], "left_anti").drop("__d")


def dangling(rows: DataFrame, link: str, objects: DataFrame, id_: str) -> DataFrame:
    """Rows whose link points to no object; null links are fine."""
    return rows.where(F.col(link).isNotNull()).join(objects.select(F.col(id_).alias(link)).distinct(), link, "left_anti")


def integrity(rows: DataFrame, id_: str, asset: str, confidence: str) -> DataFrame:
    """id and the rules that a row breaks."""
    rules = F.filter(
        F.array(
            F.when(F.col(id_).isNull(), "missing_id"),
            F.when(F.col(asset).isNull(), "missing_asset"),
            F.when(F.col(confidence).isNull() | ~F.col(confidence).between(0, 1), "confidence_range"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select(id_, rules.alias("broken")).where(F.size("broken") > 0)


def resolve(references: DataFrame, entries: DataFrame, exact: list[str], loose: list[str], id_: str) -> DataFrame:
    """References with the entry that has the same exact keys, else the only one with the same loose keys; else null."""
    one = entries.groupBy(*loose).agg(F.count("*").alias("__n"), F.min(id_).alias("__loose")).where("__n = 1").drop("__n")
    hit = entries.groupBy(*exact).agg(F.min(id_).alias("__exact"))
    return references.join(hit, exact, "left").join(one, loose, "left").withColumn("resolved", F.coalesce("__exact", "__loose")).drop("__exact", "__loose")


def effective_date(source_date: Column, created_at: Column) -> Column:
    """The date of a recording: its own, else the day it was taken in (of an ISO text)."""
    return F.coalesce(source_date, F.left(created_at, F.lit(10)))


def availability(rows: DataFrame, key: str, local: DataFrame, restorable: DataFrame, out: str) -> DataFrame:
    """local, restorable or gone by the key's presence in two tables of that key."""
    a, b = local.select(key).distinct().withColumn("__l", F.lit(True)), restorable.select(key).distinct().withColumn("__r", F.lit(True))
    x = rows.join(a, key, "left").join(b, key, "left")
    return x.withColumn(out, F.when(F.col("__l"), "local").when(F.col("__r"), "restorable").otherwise("gone")).drop("__l", "__r")


def with_active(rows: DataFrame, key: str, running: DataFrame, out: str) -> DataFrame:
    """Whether any running row has the key."""
    a = running.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct()
    return rows.join(a, F.col(key) == F.col("__k"), "left").withColumn(out, F.col("__k").isNotNull()).drop("__k")


def retract(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those taken back; what was decided before them counts again."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def reorder(items: DataFrame, wanted: list, id_: str, position: str) -> DataFrame:
    """Items in the wanted order; every item must be named exactly once."""
    have = sorted(r[0] for r in items.select(id_).limit(len(wanted) + 1).collect())
    if have != sorted(wanted):
        raise ValueError("the order must name every item once")
    place = F.create_map(*[F.lit(x) for i, w in enumerate(wanted) for x in (w, i)])
    return items.withColumn(position, place[F.col(id_)])


def stratified_latest(rows: DataFrame, label: str, id_: str, newest: list[str], pool: int, each: int, seed: str) -> DataFrame:
    """Of the newest pool rows so many of each label, by a seeded hash of the id."""
    latest_ = rows.orderBy(*[F.desc(c) for c in newest]).limit(pool)
    k = F.row_number().over(W.partitionBy(label).orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(id_).cast("string"))), id_))
    return latest_.withColumn("__k", k).where(F.col("__k") <= each).drop("__k")


def revision(content: Column) -> Column:
    """A mark of a table's contents as an aggregate: the sum of a digest of every row, so no order and no single place is needed."""
    return F.sum(F.conv(F.left(F.sha2(content, 256), F.lit(12)), 16, 10).cast("long") % 1000003)


def region_plan(markers: DataFrame, anchors: DataFrame, keys: list[str], before: float, after: float, gap: float, longest: float) -> DataFrame:
    """keys, start, end and n of the stretches that markers ask for. markers: keys, event_id, wall and own (their own position, may be null); anchors: keys, anchor, wall_a and stream.
    A marker without a position takes that of the nearest anchor in wall time (the smaller anchor of equals), moved by the difference; what falls outside the recording is left out."""
    from streamlens.operators.intervals import merge_spans, nearest

    near = nearest(markers, anchors, keys, "wall", "wall_a", "anchor")
    t = F.coalesce("own", F.col("stream") + (F.col("wall") - F.col("wall_a")))
    x = near.withColumn("t", t).where((F.col("t") >= 0) & (F.col("t") <= longest))
    spans = x.select(*keys, F.greatest(F.lit(0.0), F.col("t") - before).alias("start"), F.least(F.col("t") + after, F.lit(longest + after)).alias("end"))
    return merge_spans(spans, keys, "start", "end", gap, F.count("*").alias("n"))
