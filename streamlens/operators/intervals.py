"""Joins and merges of intervals: bucketed range joins, nearest joins, unions, differences.

A range join at scale is an equi-join on the key and on time buckets: each interval is copied
to the buckets it touches, and a pair is kept in the first bucket that both touch, so no pair comes twice
and no bucket needs another's rows. bucket should be near the intervals' usual length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, start: Column, end: Column, bucket: float, out: str) -> DataFrame:
    lo, hi = F.floor(start / bucket), F.floor(end / bucket)
    return df.withColumn(f"{out}_first", lo).withColumn(out, F.explode(F.sequence(lo, F.greatest(lo, hi))))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str], reach: float = 0.0, bucket: float = 60.0, strict: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of the same keys with r.start <= l.end + reach and r.end >= l.start - reach (strict: <, >).

    Other columns of the two sides must have different names. how: inner, left_semi or left_anti.
    """
    ls, le = F.col(l_span[0]) - reach, F.col(l_span[1]) + reach
    rs, re_ = F.col(r_span[0]), F.col(r_span[1])
    meets = ((rs < le) & (re_ > ls)) if strict else ((rs <= le) & (re_ >= ls))
    if how != "inner":
        ident = left.withColumn("__row", F.monotonically_increasing_id()) if how == "left_anti" else left
        a = _bucketed(ident, ls, le, bucket, "__b")
        b = _bucketed(right.select(*[F.col(k).alias(f"__{k}") for k in keys], *r_span), rs, re_, bucket, "__c")
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"__{k}"))
        cond = same & (F.col("__b") == F.col("__c")) & meets
        hit = a.join(b, cond, "left_semi")
        if how == "left_semi":
            return hit.drop("__b", "__b_first").distinct()
        return ident.join(hit.select("__row").distinct(), "__row", "left_anti").drop("__row")
    a = _bucketed(left, ls, le, bucket, "__b")
    b = _bucketed(right, rs, re_, bucket, "__b").withColumnRenamed("__b_first", "__c_first")
    return a.join(b, [*keys, "__b"]).where(meets & (F.col("__b") == F.greatest("__b_first", "__c_first"))).drop("__b", "__b_first", "__c_first")


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], t: str, span: tuple[str, str], pad: float = 0.0, bucket: float = 60.0, closed: bool = True, how: str = "inner") -> DataFrame:
    """Points with the spans that hold them: [start - pad, end + pad], or half-open at the end. how: inner or left_semi (each point once, without spans)."""
    lo, hi = F.col(span[0]) - pad, F.col(span[1]) + pad
    b = _bucketed(spans, lo, hi, bucket, "__b").drop("__b_first")
    a = points.withColumn("__b", F.floor(F.col(t) / bucket))
    inside = (F.col(t) >= lo) & ((F.col(t) <= hi) if closed else (F.col(t) < hi))
    if how == "left_semi":
        same = F.col("__b") == F.col("__c")
        for k in keys:
            same = same & (F.col(k) == F.col(f"__{k}"))
        b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *span, F.col("__b").alias("__c"))
        return a.join(b, same & inside, "left_semi").drop("__b")
    return a.join(b, [*keys, "__b"]).where(inside).drop("__b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, r_t: str, order: str, tolerance: float | None = None) -> DataFrame:
    """Each left row with the right row of its keys that is nearest in time; the smaller `order` wins ties; null when beyond the tolerance.

    As-of in both directions by one ordered pass: last value before and first value after.
    """
    r_cols = [c for c in right.columns if c not in keys]
    a = left.withColumn("__t", F.col(t)).withColumn("__r", F.lit(None).cast(right.select(F.struct(*r_cols)).schema[0].dataType)).withColumn("__side", F.lit(1)).withColumn("__tie", F.lit(None).cast(right.schema[order].dataType))
    b = right.select(*keys, F.col(r_t).alias("__t"), F.struct(*r_cols).alias("__r"), F.lit(0).alias("__side"), F.col(order).alias("__tie"))
    u = a.unionByName(b, allowMissingColumns=True)
    back = W.partitionBy(*keys).orderBy("__t", "__side", F.col("__tie").desc()).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(F.col("__t").desc(), "__side", F.col("__tie").desc()).rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("__p", F.last("__r", ignorenulls=True).over(back)).withColumn("__n", F.last("__r", ignorenulls=True).over(ahead)).where("__side = 1")
    dp, dn = F.abs(F.col("__t") - F.col(f"__p.{r_t}")), F.abs(F.col(f"__n.{r_t}") - F.col("__t"))
    take_p = F.col("__n").isNull() | (dp < dn) | ((dp == dn) & (F.col(f"__p.{order}") <= F.col(f"__n.{order}")))
    best = F.when(F.col("__p").isNotNull() & take_p, F.col("__p")).otherwise(F.col("__n"))
    u = u.withColumn("__best", best)
    if tolerance is not None:
        u = u.withColumn("__best", F.when(F.abs(F.col(f"__best.{r_t}") - F.col("__t")) <= tolerance, F.col("__best")))
    return u.select(*left.columns, *[F.col(f"__best.{c}").alias(c) for c in r_cols])


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column | Callable[[W], Column], out: str = "island") -> DataFrame:
    """Numbers runs from 1: a row begins a new run where breaks holds. breaks may be a function of the ordered window."""
    w = W.partitionBy(*keys).orderBy(*order)
    starts = breaks(w) if callable(breaks) else breaks
    return df.withColumn("__new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(out, F.sum("__new").over(w)).drop("__new")


def sessions(df: DataFrame, keys: list[str], t: str, max_gap: float, out: str = "session") -> DataFrame:
    """Rows at most max_gap apart share a session; exactly max_gap still does."""
    return islands(df, keys, [t], lambda w: F.col(t) - F.lag(t).over(w) > max_gap, out)


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, max_gap: float = 0.0, *aggregates: Column) -> DataFrame:
    """Union of intervals at most max_gap apart (against the furthest end so far): keys, start, end and aggregates."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = df.withColumn("__new", (reach.isNull() | (F.col(start) - reach > max_gap)).cast("int")).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), *aggregates).drop("__run")


def merge_by_last(df: DataFrame, keys: list[str], start: str, end: str, max_gap: float) -> DataFrame:
    """As merge_spans, but the gap is measured to the end of the row before, not to the furthest end."""
    runs = islands(df, keys, [start, end], lambda w: F.col(start) - F.lag(end).over(w) > max_gap, "__run")
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def subtract_spans(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start", end: str = "end", min_length: float = 0.0) -> DataFrame:
    """What of a's union is outside b's union, stretches of min_length at least: boundaries swept in order, one running sum per side."""
    marks = None
    for side, df in (("a", a), ("b", b)):
        m = merge_spans(df.select(*keys, start, end), keys, start, end)
        both = m.select(*keys, F.col(start).alias("t"), F.lit(1).alias(side)).unionByName(m.select(*keys, F.col(end).alias("t"), F.lit(-1).alias(side)))
        marks = both if marks is None else marks.unionByName(both, allowMissingColumns=True)
    at = marks.groupBy(*keys, "t").agg(F.sum(F.coalesce("a", F.lit(0))).alias("a"), F.sum(F.coalesce("b", F.lit(0))).alias("b"))
    w = W.partitionBy(*keys).orderBy("t")
    run = at.withColumn("in_a", F.sum("a").over(w)).withColumn("in_b", F.sum("b").over(w)).withColumn("to", F.lead("t").over(w))
    parts = run.where((F.col("in_a") > 0) & (F.col("in_b") <= 0) & F.col("to").isNotNull()).select(*keys, F.col("t").alias(start), F.col("to").alias(end))
    return merge_spans(parts, keys, start, end).where(F.col(end) - F.col(start) >= min_length)


def runs_where(df: DataFrame, keys: list[str], t: str, mask: Column, min_rows: int = 1, *aggregates: Column) -> DataFrame:
    """Maximal runs of neighbouring rows where mask holds: keys, start, end, n_rows and aggregates."""
    w = W.partitionBy(*keys).orderBy(t)
    m = df.withColumn("__m", F.coalesce(mask, F.lit(False)))
    m = m.withColumn("__run", F.sum((F.col("__m") != F.coalesce(F.lag("__m").over(w), ~F.col("__m"))).cast("int")).over(w)).where("__m")
    out = m.groupBy(*keys, "__run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n_rows"), *aggregates)
    return out.where(F.col("n_rows") >= min_rows).drop("__run")


def thin(df: DataFrame, keys: list[str], t: str, min_gap: float) -> DataFrame:
    """Greedy thinning: keep a time if it is more than min_gap after the last kept one (keys and t).

    A time more than min_gap after the one before it is kept whatever was kept before, so each run between
    such gaps is folded by itself, over its sorted times.
    """
    runs = sessions(df.select(*keys, F.col(t).cast("double").alias(t)), keys, t, min_gap, "__run")
    times = runs.groupBy(*keys, "__run").agg(F.array_sort(F.collect_list(t)).alias("__ts"))
    kept = F.aggregate("__ts", F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) > min_gap), F.concat(acc, F.array(x))).otherwise(acc))
    return times.select(*keys, F.explode(kept).alias(t))


def bounded_merge(df: DataFrame, keys: list[str], start: str, end: str, max_gap: float, max_span: float, cut: bool = False) -> DataFrame:
    """Union with a gap, where a region that would grow beyond max_span is closed and a new one begun; in order of start.
    With cut, an interval that is itself longer than max_span is first cut to it.

    No region reaches over a gap wider than max_gap after the furthest end so far: what lies between such gaps is folded by itself.
    """
    x = df.select(*keys, F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"))
    x = x.withColumn("e", F.least("e", F.col("s") + max_span)) if cut else x
    reach = F.max("e").over(W.partitionBy(*keys).orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
    runs = islands(x, keys, ["s", "e"], reach.isNull() | (F.col("s") - reach > max_gap), "__run")
    spans = runs.groupBy(*keys, "__run").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__x"))
    kind = "array<struct<s:double,e:double>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.greatest(last["e"], x["e"])
        joins = (F.size(acc) > 0) & (x["s"] - last["e"] <= max_gap) & (grown - last["s"] <= max_span)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), grown.alias("e"))))).otherwise(F.concat(acc, F.array(x)))

    return spans.select(*keys, F.inline(F.aggregate("__x", F.array().cast(kind), step))).withColumnsRenamed({"s": start, "e": end})


def budget_fill(df: DataFrame, keys: list[str], order: Column, seconds: str, budget: float, item: str) -> DataFrame:
    """In order, take every item that still fits the budget of seconds (skip, do not stop): keys, item, taken_seconds before it.

    Rows stream by key in order; what is held is the sum so far.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, item]), "taken_seconds double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, 0.0
        for pdf in batches:
            out = []
            for row in pdf[[*keys, item, "__s"]].itertuples(index=False, name=None):
                own, s = row[:-2], row[-1]
                if own != now:
                    now, used = own, 0.0
                if used + s <= budget:
                    out.append((*row[:-1], used))
                    used += s
            yield pd.DataFrame(out, columns=[*keys, item, "taken_seconds"])

    rows = df.select(*keys, item, F.col(seconds).cast("double").alias("__s"), order.alias("__o")).where("__s IS NOT NULL")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "__o").drop("__o").mapInPandas(run, schema)
