"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions are used.

1. Every document gets a key, the MD5 of seed and doc_id: its place in its source's random
   permutation. The key's first two hex digits are its block (256 permuted blocks a source).
2. Sizes are summed by source and block (partial sums before the shuffle). Targets are found by
   water-filling over the sources; a source whose target is above its size is taken whole
   once, and the rest of its target is taken from the start of its permutation.
3. The rest ends inside one block. The same is done again on that block's sub-blocks, and then
   on the keys of one sub-block, about a 65,536th of the source. This gives one threshold key per source;
   a document is taken when its key is not above it.
4. The blocks that a source gives (a block of the first pass and the same block of the second
   count as two) are its quota. A binary tree splits the quotas exactly among the output
   shards: at each node the left child draws half of the node's blocks without
   replacement, which is a multivariate-hypergeometric draw made source by source from its
   exact probabilities. Leaves give each shard disjoint ranges of each source's blocks.
5. Inside a shard rows are ordered by a keyed hash; mixed_rows() gives the mix shard by shard in that order.

Defined cases: a null or empty text has size 0 and is taken like any other, never more than twice; a null source is a source of its own, last in order;
rows with equal doc_id (null ids too) share a key and are taken together; a source of size 0 has target 0; a very long text is taken whole or not, so a
source may miss its target by half its longest text; an empty table gives no rows; columns of docs may have any name: where one has the name of a
column that mix() adds, the added one gets an underscore. The number of sources is that of a mix's recipe: per source there
is one row in a window and an entry in the tree's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.llm.store import free_name, materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SHARDS = 16
SEED = "mix-1"
BLOCKS = 256
#: Source tables up to this many rows are broadcast (about 100 bytes each); larger ones are joined by shuffling.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text without building them: each becomes one letter, separators go."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def permutation_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a written table when its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> also rank and target; water-filling under caps of cap * source_size."""
    everyone = W.partitionBy(F.lit(0))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by_fill = everyone.orderBy("ratio", "rank")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, W.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        by_source.withColumn("rank", rank)
        .withColumn("weight", w)
        .withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everyone)["level"])
        .withColumn("target", F.least("ceiling", F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling"))))
        .select("source", "source_size", "rank", "target")
    )


def _boundary(sums: DataFrame, group: list[str], unit: str) -> DataFrame:
    """Of each group's units in key order, the one in which the rest ends: its name, and the sum before it."""
    w = W.partitionBy(*group).orderBy(unit)
    ends = F.sum("size").over(w)
    return sums.withColumn("before", ends - F.col("size")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))


def plan_sources(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, rank, target, base (whole passes), threshold (keys up to it are taken once more)."""
    blocks = materialize(sized.groupBy("source", F.substring("key", 1, 2).alias("b1")).agg(F.sum("size").alias("size")), "mix-blocks")
    sources = targets(blocks.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = _small(materialize(sources.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "mix-sources"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    top = blocks.alias("x").join(sources.alias("s"), F.expr("x.source <=> s.source")).select("x.source", "b1", "size", "rest")
    first = _small(materialize(_boundary(top, ["source"], "b1").select("source", "b1", (F.col("rest") - F.col("before")).alias("rest")), "mix-first"))
    inner = sized.alias("x").join(first.alias("f"), F.expr("x.source <=> f.source AND substring(x.key, 1, 2) = f.b1")).select("x.source", "key", "size", "rest")
    inner = inner.groupBy("source", "rest", F.substring("key", 1, 4).alias("b2")).agg(F.sum("size").alias("size"))
    second = _small(materialize(_boundary(inner, ["source", "rest"], "b2").select("source", "b2", (F.col("rest") - F.col("before")).alias("rest")), "mix-second"))
    last = sized.alias("x").join(second.alias("f"), F.expr("x.source <=> f.source AND substring(x.key, 1, 4) = f.b2")).select("x.source", "key", "size", "rest", "b2")
    last = last.groupBy("source", "rest", "b2", "key").agg(F.sum("size").alias("size"))
    half = F.sum("size").over(W.partitionBy("source").orderBy("key")) - F.col("size") / 2
    last = last.withColumn("in", half <= F.col("rest")).groupBy("source").agg(F.coalesce(F.max(F.when(F.col("in"), F.col("key"))), F.first("b2")).alias("threshold"))
    return materialize(
        sources.alias("s").join(last.alias("t"), F.expr("s.source <=> t.source"), "left").select("s.source", "source_size", "rank", "target", "base", "rest", F.when(F.col("rest") > 0, F.coalesce("threshold", F.lit(""))).otherwise("").alias("threshold")),
        "mix-plan",
    )


#: One hypergeometric draw by inversion. s holds pool, quota, draws and u; the weights of lo..hi
#: come from the ratio of neighbouring probabilities, in logarithms, and are scaled by their maximum.
_DRAW = """
transform(array(named_struct('lo', greatest(0L, {n} - ({pool} - {k})), 'hi', least({n}, {k}))), r ->
  r.lo + transform(array(aggregate(
      CASE WHEN r.hi > r.lo THEN sequence(r.lo, r.hi - 1) ELSE array() END, array(0D),
      (a, x) -> concat(a, array(element_at(a, -1) + ln(double({k} - x)) + ln(double({n} - x)) - ln(double(x + 1)) - ln(double({pool} - {k} - {n} + x + 1)))))), a ->
    transform(array(transform(a, v -> exp(v - array_max(a)))), w ->
      aggregate(w, named_struct('sum', 0D, 'n', 0L, 'goal', {u} * aggregate(w, 0D, (p, q) -> p + q)),
        (p, q) -> named_struct('sum', p.sum + q, 'n', p.n + CASE WHEN p.sum + q < p.goal THEN 1L ELSE 0L END, 'goal', p.goal),
        p -> least(p.n, size(w) - 1L)))[0])[0])[0]
"""


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """quotas: one row with an array<bigint> column quotas. Gives shard and its quotas, which add up to the whole."""
    if shards & (shards - 1) or shards < 1:
        raise ValueError("the number of shards must be a power of two")
    draw = _DRAW.format(n="s.n", pool="s.pool", k="element_at(quotas, i)", u=f"((pmod(xxhash64('{seed}', shard, level, i), 4503599627370496L) + 0.5D) / 4503599627370496D)")
    fold = f"""
    aggregate(CASE WHEN size(quotas) > 0 THEN sequence(1, size(quotas)) ELSE array() END,
      named_struct('pool', aggregate(quotas, 0L, (p, q) -> p + q), 'n', aggregate(quotas, 0L, (p, q) -> p + q) div 2, 'x', cast(array() AS array<bigint>)),
      (s, i) -> transform(array({draw}), d -> named_struct('pool', s.pool - element_at(quotas, i), 'n', s.n - d, 'x', concat(s.x, array(d))))[0],
      s -> s.x)
    """
    nodes = quotas.select(F.lit(0).alias("shard"), "quotas")
    for level in range(shards.bit_length() - 1):
        nodes = nodes.withColumn("level", F.lit(level)).withColumn("left", F.expr(fold))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        nodes = nodes.select(F.col("shard"), F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.col("left").alias("q")), F.struct(F.lit(1).alias("bit"), right.alias("q")))).alias("c"))
        nodes = nodes.select((F.col("shard") * 2 + F.col("c.bit")).alias("shard"), F.col("c.q").alias("quotas"))
    return nodes


def block_shards(plan: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """source, b1, pass -> shard, for all blocks that the plan takes, whole or in part."""
    number = lambda c: F.conv(c, 16, 10).cast("long")
    quota = F.col("base") * BLOCKS + F.when(F.col("threshold") == "", 0).otherwise(number(F.substring("threshold", 1, 2)) + 1)
    quota = plan.select("source", "rank", quota.cast("long").alias("q"))
    one = quota.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "q"))), lambda x: x["q"]).alias("quotas"))
    leaves = split_quotas(one, shards, seed).select("shard", F.posexplode("quotas").alias("rank", "n")).withColumn("rank", F.col("rank") + 1)
    to = F.sum("n").over(W.partitionBy("rank").orderBy("shard"))
    leaves = leaves.withColumn("from", to - F.col("n")).where("n > 0")
    places = leaves.select("rank", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("place"))
    places = places.join(quota.select("rank", "source"), "rank")
    return places.select("source", F.lower(F.lpad(F.hex(F.col("place") % BLOCKS), 2, "0")).alias("b1"), F.floor(F.col("place") / BLOCKS).cast("int").alias("pass"), "shard")


#: What mix() adds to the columns of its input.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_shards", "mix_order")


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    shards: int = SHARDS,
    seed: str = SEED,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """All rows of docs with mix_size, mix_source_size, mix_target, mix_shards (one shard for each time the row is taken) and mix_order.

    A plan per source and per block is joined to docs; texts are not shuffled. sizes: the
    output of measure(docs), if it has been written already.
    """
    sized = sizes if sizes is not None else measure(docs, id_column, text_column, source_column, seed)
    plan = plan_sources(sized.select("source", "size", "key"), weights, share, cap)
    where = block_shards(plan, shards, seed).groupBy("source", "b1").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    where = materialize(plan.alias("p").join(where.alias("w"), F.expr("p.source <=> w.source"), "left").select("p.source", "source_size", "target", "base", "threshold", F.coalesce("b1", F.lit("")).alias("b1"), "draws"), "mix-draws")
    by_source = _small(plan.select(F.col("source").alias("s"), "source_size", "target", "base", "threshold"))
    draws = _small(where.select(F.col("source").alias("s2"), "b1", "draws"))
    names = docs.columns
    own = {x: f"c{i}" for i, x in enumerate(names)}
    key = permutation_key(F.col(own[id_column]), seed)
    rows = docs.toDF(*own.values()).withColumn("key", key)
    rows = rows.withColumn("words", word_count(F.col(own[text_column])) if text_column in own else F.col(own["size"]))
    rows = rows.join(by_source, F.col(own[source_column]).eqNullSafe(F.col("s"))).join(draws, F.col(own[source_column]).eqNullSafe(F.col("s2")) & (F.substring("key", 1, 2) == F.col("b1")), "left")
    times = F.col("base") + (F.col("key") <= F.col("threshold")).cast("long")
    taken = F.filter(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int>>")), lambda d: d["pass"] < times)
    added = [F.col("words"), F.col("source_size"), F.col("target"), F.transform(taken, lambda d: d["shard"]), F.xxhash64(F.lit(seed), "key")]
    return rows.select(*own.values(), *added).toDF(*names, *(free_name(names, x) for x in ADDED))


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size and key of every row, written: texts are read once for all that follows."""
    return materialize(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"), permutation_key(F.col(id_column), seed).alias("key")), "mix-sizes")


def take(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its shard and its order inside it. columns: those of mix()'s input."""
    shards, order = (free_name(columns, x) for x in ("mix_shards", "mix_order"))
    return mixed.select(*columns, F.col(order), F.explode(F.col(shards)).alias(free_name(columns, "mix_shard")))


def mixed_rows(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """docs' columns of the mix, shard after shard and inside a shard in its shuffled order: partitions are ranges of (shard, order)."""
    names, n = docs.columns, partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard, order = free_name(names, "mix_shard"), free_name(names, "mix_order")
    return take(mix(docs, **options), names).repartitionByRange(n, shard, order).sortWithinPartitions(shard, order).select(*names)
