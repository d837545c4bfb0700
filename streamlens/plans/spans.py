"""Interval joins, merges and lookups: events as points, bursts of purchases and clicks as spans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions import intervals as fi
from streamlens.functions import times
from streamlens.operators import intervals
from streamlens.plans.base import SECONDS, Plans, events
from streamlens.session import table

P = Plans()


def _spans(spark, sf_dir, kind: str, length: float, prefix: str):
    """An interval of each event of a kind: [s, s + length * (1 + event_id % 4)]."""
    e = events(spark, sf_dir).where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("s").alias(f"{prefix}_start"), (F.col("s") + length * (1 + F.col("event_id") % 4)).alias(f"{prefix}_end"), F.col("value").alias(f"{prefix}_value"))


def _sql(kind: str, length: float, prefix: str) -> str:
    return f"{prefix} AS (SELECT user_id, event_id AS {prefix}_id, {SECONDS} AS {prefix}_start, {SECONDS} + {length}::DOUBLE * (1 + event_id % 4) AS {prefix}_end, value AS {prefix}_value FROM events WHERE event_type = '{kind}')"


CLIPS, LINES = ("purchase", 20000.0, "c"), ("click", 9000.0, "l")
_CL = f"{_sql(*CLIPS)}, {_sql(*LINES)}"


@P.add(f"""WITH {_CL} SELECT l_id, c_id, round(greatest(0, c_start - l_end, l_start - c_end), 3) AS gap FROM l JOIN c ON l.user_id = c.user_id AND c_start <= l_end + 1800 AND c_end >= l_start - 1800""")
def bridge_join(spark, sf_dir):
    """Transcript spans with the clips near them (range join with reach), and the gap between."""
    j = intervals.range_join(_spans(spark, sf_dir, *LINES), _spans(spark, sf_dir, *CLIPS), ["user_id"], ("l_start", "l_end"), ("c_start", "c_end"), 1800.0, 40000.0)
    g = fi.gap(F.col("l_start"), F.col("l_end"), F.col("c_start"), F.col("c_end"))
    return j.select("l_id", "c_id", F.round(g, 3).alias("gap"))


@P.add(f"""WITH {_CL} SELECT c_id, string_agg(l_id::VARCHAR, ' ' ORDER BY l_start, l_id) AS lines, round(sum(greatest(0, least(l_end, c_end) - greatest(l_start, c_start))), 3) AS covered FROM c JOIN l ON l.user_id = c.user_id AND l_start < c_end AND l_end > c_start GROUP BY c_id""")
def spoken_in_clip(spark, sf_dir):
    """Lines strictly overlapping each clip, joined in order of time."""
    j = intervals.range_join(_spans(spark, sf_dir, *CLIPS), _spans(spark, sf_dir, *LINES), ["user_id"], ("c_start", "c_end"), ("l_start", "l_end"), 0.0, 40000.0, strict=True)
    o = fi.overlap(F.col("l_start"), F.col("l_end"), F.col("c_start"), F.col("c_end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_start", "l_id"))), lambda x: x["l_id"].cast("string")), " ")
    return j.groupBy("c_id").agg(text.alias("lines"), F.round(F.sum(o), 3).alias("covered"))


@P.add(f"""WITH {_CL}, e AS (SELECT user_id, event_id, value, {SECONDS} AS s FROM events WHERE event_type = 'view')
SELECT c_id, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS top FROM c JOIN e ON e.user_id = c.user_id AND s BETWEEN c_start - 300 AND c_end + 300 GROUP BY c_id""")
def signals_in_clip(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", "value", "s")
    j = intervals.points_in(e, _spans(spark, sf_dir, *CLIPS), ["user_id"], "s", ("c_start", "c_end"), 300.0, 40000.0)
    return j.groupBy("c_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("top"))


@P.add(f"""WITH {_CL}, e AS (SELECT user_id, event_id, {SECONDS} AS s FROM events WHERE event_type = 'error'),
f AS (SELECT event_id, c_id, row_number() OVER (PARTITION BY event_id ORDER BY c_start, c_id) AS r FROM e JOIN c ON e.user_id = c.user_id AND s >= c_start AND s < c_end)
SELECT e.event_id, coalesce(f.c_id, -1)::BIGINT AS c_id FROM e LEFT JOIN f ON f.event_id = e.event_id AND r = 1""")
def first_segment_at(spark, sf_dir):
    """The first half-open span that holds each point, or a default."""
    e = events(spark, sf_dir).where("event_type = 'error'").select("user_id", "event_id", "s")
    j = intervals.points_in(e, _spans(spark, sf_dir, *CLIPS), ["user_id"], "s", ("c_start", "c_end"), 0.0, 40000.0, closed=False)
    first = j.groupBy("event_id").agg(F.min(F.struct("c_start", "c_id"))["c_id"].alias("c_id"))
    return e.select("event_id").join(first, "event_id", "left").select("event_id", F.coalesce("c_id", F.lit(-1)).alias("c_id"))


@P.add(f"""WITH {_CL}, j AS (SELECT l_id, c_id, greatest(0, least(l_end, c_end) - greatest(l_start, c_start)) / (l_end - l_start) AS share FROM l JOIN c ON l.user_id = c.user_id AND c_start <= l_end AND c_end >= l_start)
SELECT l_id, arg_max(c_id, (share, -c_id)) AS c_id, round(max(share), 5) AS share FROM j GROUP BY l_id HAVING max(share) >= 0.5""")
def best_clip_for_moment(spark, sf_dir):
    j = intervals.range_join(_spans(spark, sf_dir, *LINES), _spans(spark, sf_dir, *CLIPS), ["user_id"], ("l_start", "l_end"), ("c_start", "c_end"), 0.0, 40000.0)
    share = fi.overlap_of_first(F.col("l_start"), F.col("l_end"), F.col("c_start"), F.col("c_end"))
    best = j.groupBy("l_id").agg(F.max(F.struct(share.alias("share"), (-F.col("c_id")).alias("c"))).alias("b")).where("b.share >= 0.5")
    return best.select("l_id", (-F.col("b.c")).alias("c_id"), F.round("b.share", 5).alias("share"))


@P.add(f"""WITH {_CL} SELECT l_id FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = l.user_id AND c_start < l_end AND c_end > l_start)""")
def uncovered_lines(spark, sf_dir):
    return intervals.range_join(_spans(spark, sf_dir, *LINES), _spans(spark, sf_dir, *CLIPS), ["user_id"], ("l_start", "l_end"), ("c_start", "c_end"), 0.0, 40000.0, strict=True, how="left_anti").select("l_id")


@P.add(f"""WITH {_CL} SELECT l_id FROM l WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = l.user_id AND c_start <= l_end AND c_end >= l_start)""")
def covered_lines(spark, sf_dir):
    return intervals.range_join(_spans(spark, sf_dir, *LINES), _spans(spark, sf_dir, *CLIPS), ["user_id"], ("l_start", "l_end"), ("c_start", "c_end"), 0.0, 40000.0, how="left_semi").select("l_id")


@P.add(f"""WITH a AS (SELECT user_id, event_id AS anchor_id, {SECONDS} AS a_s FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, event_id, {SECONDS} AS s FROM events WHERE event_type = 'error'),
r AS (SELECT event_id, anchor_id, abs(a_s - s) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(a_s - s), anchor_id) AS r FROM e JOIN a ON a.user_id = e.user_id)
SELECT e.event_id, CASE WHEN d <= 43200 THEN anchor_id END AS anchor_id FROM e LEFT JOIN r ON r.event_id = e.event_id AND r = 1""")
def nearest_anchor(spark, sf_dir):
    """As-of join in both directions with a tolerance."""
    e = events(spark, sf_dir)
    a = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("anchor_id"), F.col("s").alias("a_s"))
    x = e.where("event_type = 'error'").select("user_id", "event_id", "s")
    return intervals.nearest(x, a, ["user_id"], "s", "a_s", "anchor_id", 43200.0).select("event_id", "anchor_id")


_MERGED = f"""
{_CL}, o AS (SELECT *, max(c_end) OVER (PARTITION BY user_id ORDER BY c_start, c_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR c_start - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY c_start, c_end) AS run FROM o)
"""


@P.add(f"""WITH {_MERGED} SELECT user_id, round(min(c_start), 3) AS start, round(max(c_end), 3) AS "end", count(*)::BIGINT AS n, round(sum(c_value), 4) AS weight, string_agg(c_id::VARCHAR, ',' ORDER BY c_id) AS ids FROM r GROUP BY user_id, run""")
def merged_regions(spark, sf_dir):
    """Union of spans with a gap, carrying counts, sums and ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c_id")), lambda x: x.cast("string")), ",")
    m = intervals.merge_spans(_spans(spark, sf_dir, *CLIPS), ["user_id"], "c_start", "c_end", 3600.0, F.count("*").alias("n"), F.sum("c_value").alias("weight"), ids.alias("ids"))
    return m.select("user_id", F.round("c_start", 3).alias("start"), F.round("c_end", 3).alias("end"), "n", F.round("weight", 4).alias("weight"), "ids")


@P.add(f"""WITH {_CL}, o AS (SELECT *, lag(c_end) OVER (PARTITION BY user_id ORDER BY c_start, c_end) AS last FROM c),
r AS (SELECT *, sum(CASE WHEN last IS NULL OR c_start - last > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY c_start, c_end) AS run FROM o)
SELECT user_id, round(min(c_start), 3) AS start, round(max(c_end), 3) AS "end" FROM r GROUP BY user_id, run""")
def clustered_by_last(spark, sf_dir):
    m = intervals.merge_by_last(_spans(spark, sf_dir, *CLIPS), ["user_id"], "c_start", "c_end", 3600.0)
    return m.select("user_id", F.round("c_start", 3).alias("start"), F.round("c_end", 3).alias("end"))


@P.add(f"""WITH RECURSIVE t AS (SELECT user_id, {SECONDS} AS s, row_number() OVER (PARTITION BY user_id ORDER BY {SECONDS}) AS i FROM events),
k AS (SELECT user_id, i, s AS kept, s FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, CASE WHEN t.s - k.kept > 50000 THEN t.s ELSE k.kept END, t.s FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1)
SELECT user_id, round(s, 3) AS s FROM k WHERE s = kept""")
def thinned_markers(spark, sf_dir):
    """Greedy thinning against the last kept marker."""
    return intervals.thin(events(spark, sf_dir), ["user_id"], "s", 50000.0).select("user_id", F.round("s", 3).alias("s"))


@P.add(f"""WITH RECURSIVE {_sql(*CLIPS)}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c_start, c_end) AS i FROM c),
k AS (SELECT user_id, i, c_start AS a, c_end AS b, 1 AS region FROM t WHERE i = 1
 UNION ALL SELECT t.user_id, t.i, CASE WHEN t.c_start - k.b <= 3600 AND greatest(k.b, t.c_end) - k.a <= 90000 THEN k.a ELSE t.c_start END, CASE WHEN t.c_start - k.b <= 3600 AND greatest(k.b, t.c_end) - k.a <= 90000 THEN greatest(k.b, t.c_end) ELSE t.c_end END,
   CASE WHEN t.c_start - k.b <= 3600 AND greatest(k.b, t.c_end) - k.a <= 90000 THEN k.region ELSE k.region + 1 END FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1)
SELECT user_id, round(max(a), 3) AS start, round(max(b), 3) AS "end" FROM k GROUP BY user_id, region""")
def bounded_regions(spark, sf_dir):
    """Merge with a gap under a bound of span; the state is folded in order."""
    m = intervals.bounded_merge(_spans(spark, sf_dir, *CLIPS), ["user_id"], "c_start", "c_end", 3600.0, 90000.0)
    return m.select("user_id", F.round("c_start", 3).alias("start"), F.round("c_end", 3).alias("end"))


_CUT = "t.c_start - k.b <= 3600 AND greatest(k.b, t.c_end) - k.a <= 50000"


@P.add(f"""WITH RECURSIVE {_sql(*CLIPS)}, t AS (SELECT user_id, c_start, least(c_end, c_start + 50000) AS c_end, row_number() OVER (PARTITION BY user_id ORDER BY c_start, least(c_end, c_start + 50000)) AS i FROM c),
k AS (SELECT user_id, i, c_start AS a, c_end AS b, 1 AS region FROM t WHERE i = 1
 UNION ALL SELECT t.user_id, t.i, CASE WHEN {_CUT} THEN k.a ELSE t.c_start END, CASE WHEN {_CUT} THEN greatest(k.b, t.c_end) ELSE t.c_end END, CASE WHEN {_CUT} THEN k.region ELSE k.region + 1 END FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1)
SELECT user_id, round(max(a), 3) AS start, round(max(b), 3) AS "end" FROM k GROUP BY user_id, region""")
def cut_regions(spark, sf_dir):
    """The same, where a span beyond the bound is cut to it before it is merged."""
    m = intervals.bounded_merge(_spans(spark, sf_dir, *CLIPS), ["user_id"], "c_start", "c_end", 3600.0, 50000.0, cut=True)
    return m.select("user_id", F.round("c_start", 3).alias("start"), F.round("c_end", 3).alias("end"))


@P.add(f"""WITH RECURSIVE {_sql(*CLIPS)}, t AS (SELECT *, c_end - c_start AS len, row_number() OVER (PARTITION BY user_id ORDER BY c_value DESC, c_id) AS i FROM c),
k AS (SELECT user_id, i, c_id, CASE WHEN len <= 120000 THEN len ELSE 0 END AS used, len <= 120000 AS kept, 0::DOUBLE AS before FROM t WHERE i = 1
 UNION ALL SELECT t.user_id, t.i, t.c_id, CASE WHEN k.used + len <= 120000 THEN k.used + len ELSE k.used END, k.used + len <= 120000, k.used FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1)
SELECT user_id, c_id, round(before, 2) AS taken_seconds FROM k WHERE kept""")
def budgeted_clips(spark, sf_dir):
    """Best first under a budget of seconds; what does not fit is skipped."""
    c = _spans(spark, sf_dir, *CLIPS).withColumn("len", F.col("c_end") - F.col("c_start"))
    k = intervals.budget_fill(c, ["user_id"], F.struct((-F.col("c_value")).alias("v"), F.col("c_id")), "len", 120000.0, "c_id")
    return k.select("user_id", "c_id", F.round("taken_seconds", 2).alias("taken_seconds"))


@P.add(f"""WITH {_CL},
edges AS (SELECT user_id, c_start AS t FROM c UNION SELECT user_id, c_end FROM c UNION SELECT user_id, l_start FROM l UNION SELECT user_id, l_end FROM l),
parts AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM edges),
free AS (SELECT p.* FROM parts p WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c_start <= a AND c_end >= b) AND NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = p.user_id AND l_start <= a AND l_end >= b))
SELECT user_id, round(sum(b - a), 2) AS seconds FROM free GROUP BY user_id""")
def uncovered_seconds(spark, sf_dir):
    """What of the clips no line covers: interval difference of two unions."""
    a = _spans(spark, sf_dir, *CLIPS).select("user_id", F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    b = _spans(spark, sf_dir, *LINES).select("user_id", F.col("l_start").alias("start"), F.col("l_end").alias("end"))
    return intervals.subtract_spans(a, b, ["user_id"]).groupBy("user_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 2).alias("seconds"))


@P.add(f"""WITH {_CL},
edges AS (SELECT user_id, c_start AS t FROM c UNION SELECT user_id, c_end FROM c UNION SELECT user_id, l_start FROM l UNION SELECT user_id, l_end FROM l),
parts AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM edges),
free AS (SELECT p.* FROM parts p WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c_start <= a AND c_end >= b) AND NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = p.user_id AND l_start <= a AND l_end >= b)),
runs AS (SELECT *, sum(CASE WHEN a = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a) AS run FROM (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY a) AS before FROM free))
SELECT user_id, round(min(a), 3) AS start, round(max(b), 3) AS "end" FROM runs GROUP BY user_id, run HAVING max(b) - min(a) >= 6000""")
def uncovered_ranges(spark, sf_dir):
    """The stretches of clips that no line covers, those of some length."""
    a = _spans(spark, sf_dir, *CLIPS).select("user_id", F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    b = _spans(spark, sf_dir, *LINES).select("user_id", F.col("l_start").alias("start"), F.col("l_end").alias("end"))
    return intervals.subtract_spans(a, b, ["user_id"], min_length=6000.0).select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@P.add(f"""WITH {_CL}, g AS (SELECT user_id, c_id, c_start, c_value, row_number() OVER (PARTITION BY user_id, floor(c_start / 200000) ORDER BY c_value DESC, c_id) AS r FROM c)
SELECT user_id, c_id FROM g WHERE r <= 2""")
def best_per_bin(spark, sf_dir):
    """Stratified pool: the best two spans of each stretch of time."""
    w = W.partitionBy("user_id", F.floor(F.col("c_start") / 200000)).orderBy(F.desc("c_value"), "c_id")
    return _spans(spark, sf_dir, *CLIPS).withColumn("r", F.row_number().over(w)).where("r <= 2").select("user_id", "c_id")


@P.add(f"""WITH {_CL}, p AS (SELECT x.c_id AS a, y.c_id AS b, greatest(0, least(x.c_end, y.c_end) - greatest(x.c_start, y.c_start)) AS o, x.c_end - x.c_start AS la, y.c_end - y.c_start AS lb FROM c x JOIN c y ON x.user_id = y.user_id AND x.c_id < y.c_id AND y.c_start <= x.c_end AND y.c_end >= x.c_start)
SELECT a, b, round(o / least(la, lb), 5) AS of_shorter, round(o / la, 5) AS of_first, round(o / (la + lb - o), 5) AS iou FROM p""")
def overlap_ratios(spark, sf_dir):
    a = _spans(spark, sf_dir, *CLIPS)
    b = a.select("user_id", F.col("c_id").alias("d_id"), F.col("c_start").alias("d_start"), F.col("c_end").alias("d_end"))
    j = intervals.range_join(a, b, ["user_id"], ("c_start", "c_end"), ("d_start", "d_end"), 0.0, 40000.0).where("c_id < d_id")
    x = [F.col(c) for c in ("c_start", "c_end", "d_start", "d_end")]
    return j.select(F.col("c_id").alias("a"), F.col("d_id").alias("b"), F.round(fi.overlap_of_shorter(*x), 5).alias("of_shorter"), F.round(fi.overlap_of_first(*x), 5).alias("of_first"), F.round(fi.interval_iou(*x), 5).alias("iou"))


@P.add(f"""WITH e AS (SELECT user_id, event_id, event_type, {SECONDS} AS s FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY s) AS g FROM e)
SELECT user_id, event_type, count(*)::BIGINT AS n, round(min(s), 3) AS start, round(max(s), 3) AS "end" FROM r GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def label_runs(spark, sf_dir):
    """Runs of the same label."""
    r = intervals.islands(events(spark, sf_dir), ["user_id"], ["s"], lambda w: F.col("event_type") != F.lag("event_type").over(w))
    return r.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), F.round(F.min("s"), 3).alias("start"), F.round(F.max("s"), 3).alias("end")).where("n >= 3").drop("island")


@P.add(f"""WITH e AS (SELECT event_id, {SECONDS} AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', (floor(s)::BIGINT) // 3600, (floor(s)::BIGINT) % 3600 // 60, floor(s)::BIGINT % 60) ELSE printf('%d:%02d', floor(s)::BIGINT // 60, floor(s)::BIGINT % 60) END AS clock FROM e""")
def clock_texts(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", times.clock(F.col("s")).alias("clock"))


@P.add("""SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m-%d') AS previous, monthname(o_orderdate) AS month, strftime(o_orderdate - INTERVAL 6 DAY, '%Y-%m-%d') AS week_ago FROM orders""")
def date_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    first, last = times.month_bounds(F.col("d"))
    previous, _ = times.month_bounds(F.col("d"), -1)
    ago, _ = times.rolling_bounds(F.col("d"), 7)
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select("o_orderkey", text(first).alias("first"), text(last).alias("last"), text(previous).alias("previous"), times.month_name(F.col("d")).alias("month"), text(ago).alias("week_ago"))


QUERIES, ORACLE = P.queries, P.oracle
