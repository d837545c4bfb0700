"""Signals: dense tracks, robust scores, arcs, sessions, smoothing and downsampling over events.

An event's user stands for a recording and an hour for a second of it.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions.scoring import saturate, squash
from streamlens.operators import arcs, intervals, robust, tracks
from streamlens.plans.base import SECONDS, Plans, events

P = Plans()
HOUR = 3600.0


def _hourly(spark, sf_dir):
    """Per user and hour of the table's days, from its first to its last: events, their value and errors; 0 where there are none."""
    e = events(spark, sf_dir)
    day = F.floor(F.col("s") / (24 * HOUR))
    span = e.agg((F.min(day) * 24).alias("a"), (F.max(day) * 24 + 23).alias("b"))
    bounds = e.select("user_id").distinct().join(F.broadcast(span), F.lit(True))
    return tracks.dense_histogram(e, ["user_id"], F.col("s") / HOUR, bounds, "a", "b", n=F.count("*"), weight=F.sum("value"), errors=F.count_if(F.col("event_type") == "error"))


_HOURLY = f"""
hourly AS (
  SELECT u.user_id, t.t, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(errors, 0) AS errors
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range((floor(min({SECONDS}) / 86400) * 24)::BIGINT, (floor(max({SECONDS}) / 86400) * 24)::BIGINT + 24)) AS t FROM events) t
  LEFT JOIN (SELECT user_id, floor({SECONDS} / 3600)::BIGINT AS t, count(*) AS n, sum(value) AS weight, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2) h
    ON h.user_id = u.user_id AND h.t = t.t)
"""


@P.add(f"WITH {_HOURLY} SELECT user_id, t, n::BIGINT AS n, round(weight, 4) AS weight, errors::BIGINT AS errors FROM hourly")
def dense_track(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return h.select("user_id", "t", "n", F.round("weight", 4).alias("weight"), "errors")


_SCORED = f"""
{_HOURLY},
daily AS (SELECT user_id, t // 24 AS t, sum(weight) AS weight FROM hourly GROUP BY 1, 2),
mid AS (SELECT user_id, quantile_cont(weight, 0.5) AS med FROM daily GROUP BY 1),
spread AS (SELECT d.user_id, med, quantile_cont(abs(weight - med), 0.5) AS mad FROM daily d JOIN mid USING (user_id) GROUP BY 1, 2)
"""


def _daily(spark, sf_dir):
    return _hourly(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 24).alias("t")).agg(F.sum("weight").alias("weight"))


@P.add(f"WITH {_SCORED} SELECT user_id, t, round(greatest(-4, least(8, (weight - med) / greatest(1e-6, mad * 1.4826))), 5) AS z FROM daily JOIN spread USING (user_id)")
def robust_scores(spark, sf_dir):
    return robust.with_robust_z(_daily(spark, sf_dir), ["user_id"], "weight").select("user_id", "t", F.round("z", 5).alias("z"))


@P.add(f"WITH {_SCORED} SELECT user_id, t, round(1 - exp(-greatest(0, least(6, greatest(-4, least(8, (weight - med) / greatest(1e-6, mad * 1.4826))))) / 2), 5) AS level FROM daily JOIN spread USING (user_id)")
def saturated_levels(spark, sf_dir):
    return robust.with_saturation(_daily(spark, sf_dir), ["user_id"], "weight").select("user_id", "t", F.round("level", 5).alias("level"))


@P.add(f"WITH {_SCORED} SELECT user_id, round(med + 2 * 1.4826 * mad, 5) AS theta FROM spread")
def curve_thresholds(spark, sf_dir):
    return robust.thresholds(_daily(spark, sf_dir), ["user_id"], "weight", 2.0).select("user_id", F.round("theta", 5).alias("theta"))


@P.add(f"""WITH {_SCORED}, z AS (SELECT user_id, t, (weight - med) / greatest(mad * 1.4826, abs(med) * 0.05, 1e-6) AS z FROM daily JOIN spread USING (user_id))
SELECT user_id, t, round(z, 5) AS z FROM z WHERE z > 2.5""")
def cut_spikes(spark, sf_dir):
    return robust.spikes(_daily(spark, sf_dir), ["user_id"], "weight").select("user_id", "t", F.round("z", 5).alias("z"))


@P.add(f"""
WITH {_SCORED},
lim AS (SELECT user_id, med + 2 * 1.4826 * mad AS theta, med + 0.5 * 1.4826 * mad AS onset FROM spread),
marked AS (
  SELECT d.user_id, t, weight, weight > theta AS hot,
         coalesce(last_value(CASE WHEN weight <= onset THEN t END IGNORE NULLS) OVER (PARTITION BY d.user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(t) OVER (PARTITION BY d.user_id)) AS lo,
         coalesce(first_value(CASE WHEN weight <= onset THEN t END IGNORE NULLS) OVER (PARTITION BY d.user_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(t) OVER (PARTITION BY d.user_id)) AS hi
  FROM daily d JOIN lim USING (user_id)),
numbered AS (SELECT *, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS run FROM marked WHERE hot)
SELECT user_id, min(lo)::BIGINT AS start, max(hi)::BIGINT AS "end", arg_max(t, (weight, -t))::BIGINT AS peak_time, round(max(weight), 4) AS peak_value, count(*)::BIGINT AS n_rows, round(sum(weight), 4) AS auc
FROM numbered GROUP BY user_id, run""")
def burst_arcs(spark, sf_dir):
    found = arcs.find_arcs(_daily(spark, sf_dir), ["user_id"], "t", "weight")
    return found.select("user_id", "start", "end", "peak_time", F.round("peak_value", 4).alias("peak_value"), "n_rows", F.round("auc", 4).alias("auc"))


_SESSIONS = f"""
s AS (SELECT user_id, event_id, event_type, value, {SECONDS} AS s FROM events),
gaps AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 7200 THEN 0 ELSE 1 END AS fresh FROM s),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s) AS session FROM gaps)
"""


@P.add(f"WITH {_SESSIONS} SELECT user_id, session::BIGINT AS session, round(min(s), 3) AS first_s, round(max(s) - min(s), 3) AS span, count(*)::BIGINT AS n, round(sum(value), 4) AS weight FROM numbered GROUP BY 1, 2")
def burst_sessions(spark, sf_dir):
    x = intervals.sessions(events(spark, sf_dir), ["user_id"], "s", 7200.0)
    return x.groupBy("user_id", "session").agg(F.round(F.min("s"), 3).alias("first_s"), F.round(F.max("s") - F.min("s"), 3).alias("span"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("weight"))


@P.add(f"WITH {_HOURLY}, d AS (SELECT user_id, t, n, avg(n) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth, max(n) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS wide FROM hourly) SELECT user_id, t, round(smooth, 6) AS smooth, wide::BIGINT AS wide FROM d WHERE smooth > 0")
def smoothed_track(spark, sf_dir):
    h = tracks.moving_average(_hourly(spark, sf_dir), ["user_id"], "t", "n", 6, "smooth")
    h = tracks.dilate(h, ["user_id"], "t", "n", 1, "wide")
    return h.where("smooth > 0").select("user_id", "t", F.round("smooth", 6).alias("smooth"), "wide")


@P.add(f"WITH {_SCORED}, d AS (SELECT user_id, t, weight, quantile_cont(weight, 0.5) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS base FROM daily) SELECT user_id, t, round(coalesce(greatest(0, weight - base), 0), 4) AS startle FROM d")
def startle_track(spark, sf_dir):
    d = tracks.rise_over_median(_daily(spark, sf_dir), ["user_id"], "t", "weight", 3, "startle")
    return d.select("user_id", "t", F.round("startle", 4).alias("startle"))


@P.add(f"""WITH {_SCORED},
f AS (SELECT user_id, t, weight, list(weight) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS l FROM daily),
m AS (SELECT *, list_aggregate(l, 'quantile_cont', 0.5) AS med FROM f),
z AS (SELECT *, list_aggregate(list_transform(l, lambda v: abs(v - med)), 'quantile_cont', 0.5) AS mad FROM m)
SELECT user_id, t, round(least(5, greatest(0, (weight - med) / greatest(mad * 1.4826, 0.005))), 5) AS z FROM z""")
def trailing_scores(spark, sf_dir):
    d = tracks.trailing_z(_daily(spark, sf_dir), ["user_id"], "t", "weight", 7, 0.005, 5.0, "z")
    return d.select("user_id", "t", F.round("z", 5).alias("z"))


@P.add(f"""WITH {_SCORED}, i AS (SELECT user_id, t, weight, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM daily)
SELECT a.user_id, a.t, round(sum(b.weight) / 4, 5) AS mean FROM i a CROSS JOIN (SELECT unnest([-2, -1, 0, 1]) AS o) JOIN i b ON b.user_id = a.user_id AND b.i = least(a.n, greatest(1, a.i + o)) GROUP BY 1, 2""")
def edge_box_mean(spark, sf_dir):
    d = tracks.box_mean(_daily(spark, sf_dir), ["user_id"], "t", "weight", -2, 1, "mean")
    return d.select("user_id", "t", F.round("mean", 5).alias("mean"))


@P.add(f"""WITH {_HOURLY}, r AS (SELECT user_id, t, n, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS run FROM hourly WHERE n >= 1)
SELECT user_id, min(t)::BIGINT AS start, max(t)::BIGINT AS "end", count(*)::BIGINT AS n_rows, max(n)::BIGINT AS top FROM r GROUP BY user_id, run HAVING count(*) >= 2""")
def active_runs(spark, sf_dir):
    return intervals.runs_where(_hourly(spark, sf_dir), ["user_id"], "t", F.col("n") >= 1, 2, F.max("n").alias("top"))


@P.add(f"SELECT user_id, least(11, floor({SECONDS} / 200000))::INT AS bin, count(*)::BIGINT AS n, round(max(value), 4) AS top FROM events GROUP BY 1, 2")
def fixed_bins(spark, sf_dir):
    return tracks.bins(events(spark, sf_dir), ["user_id"], F.col("s"), 200000.0, 12, n=F.count("*"), top=F.round(F.max("value"), 4))


@P.add(f"""WITH s AS (SELECT user_id, {SECONDS} AS s, value, row_number() OVER (PARTITION BY user_id ORDER BY {SECONDS}) - 1 AS i, ceil(count(*) OVER (PARTITION BY user_id) / 20.0)::BIGINT AS step FROM events),
p AS (SELECT user_id, i // step AS point, min(s) AS s, max(value) AS peak FROM s GROUP BY 1, 2)
SELECT user_id, point::BIGINT AS point, round(s, 3) AS s, round(peak, 4) AS peak, round(CASE WHEN max(peak) OVER (PARTITION BY user_id) > 0 THEN peak / max(peak) OVER (PARTITION BY user_id) ELSE 0 END, 6) AS level FROM p""")
def downsampled_curve(spark, sf_dir):
    d = tracks.downsample_max(events(spark, sf_dir).select("user_id", "s", "value"), ["user_id"], "s", "value", 20)
    return d.select("user_id", "point", F.round("s", 3).alias("s"), F.round("peak", 4).alias("peak"), F.round("level", 6).alias("level"))


@P.add(f"""WITH s AS (SELECT user_id, event_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events)
SELECT event_id, round(CASE WHEN n > 1 THEN (r - 1) / (n - 1)::DOUBLE ELSE 0 END, 6) AS share FROM s""")
def percentile_ranks(spark, sf_dir):
    d = tracks.percentile_rank(events(spark, sf_dir), ["user_id"], "value", "event_id", "share")
    return d.select("event_id", F.round("share", 6).alias("share"))


@P.add("""WITH s AS (SELECT event_id, user_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, round(CASE WHEN n = 1 THEN 0.99 WHEN hi = lo THEN 0.785 ELSE 0.58 + 0.41 * (value - lo) / (hi - lo) END, 5) AS shown FROM s""")
def display_scale(spark, sf_dir):
    d = tracks.min_max(events(spark, sf_dir), ["user_id"], "value", 0.58, 0.99, "shown")
    return d.select("event_id", F.round("shown", 5).alias("shown"))


@P.add(f"""WITH s AS (SELECT user_id, {SECONDS} AS s, value, event_id, event_type FROM events),
h AS (SELECT user_id, round_even({SECONDS} / 3600, 0)::BIGINT AS k, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2, 3),
line AS (SELECT DISTINCT user_id, k FROM h)
SELECT l.user_id, l.k, round(coalesce(c.v, 0), 4) AS click, round(coalesce(x.v, 0), 4) AS error FROM line l
LEFT JOIN h c ON c.user_id = l.user_id AND c.k = l.k AND c.event_type = 'click' LEFT JOIN h x ON x.user_id = l.user_id AND x.k = l.k AND x.event_type = 'error'""")
def aligned_tracks(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("h", F.col("s") / HOUR)
    line = e.select("user_id", F.bround("h").cast("long").alias("k")).distinct()
    one = lambda kind: (e.where(F.col("event_type") == kind).select("user_id", "h", "value", "event_id"), "h", "value", "event_id")
    out = tracks.align(line, ["user_id"], "k", {"click": one("click"), "error": one("error")})
    return out.select("user_id", "k", F.round("click", 4).alias("click"), F.round("error", 4).alias("error"))


@P.add(f"""WITH {_HOURLY}, r AS (SELECT user_id, floor({SECONDS} / 3600)::BIGINT AS t, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), b AS (SELECT user_id, t, weight FROM hourly WHERE n > 0)
SELECT coalesce(b.user_id, r.user_id) AS user_id, coalesce(b.t, r.t) AS t, round(CASE WHEN r.user_id IS NOT NULL THEN r.v ELSE b.weight END, 4) AS weight FROM b FULL JOIN r ON b.user_id = r.user_id AND b.t = r.t""")
def refined_overlay(spark, sf_dir):
    base = _hourly(spark, sf_dir).where("n > 0").select("user_id", "t", "weight")
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    refined = e.groupBy("user_id", F.floor(F.col("s") / HOUR).alias("t")).agg(F.max("value").alias("weight"))
    return tracks.overlay(base, refined, ["user_id", "t"], ["weight"]).withColumn("weight", F.round("weight", 4))


@P.add(f"""WITH {_HOURLY}, x AS (SELECT user_id, t, weight, errors, n FROM hourly WHERE n > 0)
SELECT user_id, t, round(0.68 * weight / (weight + 1) + 0.2 * least(errors, 1) + 0.12 * n / (n + 2.5), 6) AS hook FROM x""")
def hook_scores(spark, sf_dir):
    h = _hourly(spark, sf_dir).where("n > 0")
    hook = 0.68 * squash(F.col("weight"), 1.0) + 0.2 * F.least("errors", F.lit(1)) + 0.12 * squash(F.col("n"), 2.5)
    return h.select("user_id", "t", F.round(hook, 6).alias("hook"))


@P.add(f"""WITH {_HOURLY}, c AS (SELECT user_id, t, max(weight) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, n FROM hourly)
SELECT user_id, t, round(held, 4) AS held FROM c WHERE n > 0""")
def high_water(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return _hourly(spark, sf_dir).withColumn("held", F.max("weight").over(w)).where("n > 0").select("user_id", "t", F.round("held", 4).alias("held"))


@P.add(f"""SELECT user_id, floor({SECONDS} / 43200)::BIGINT AS bucket, round(sqrt(avg(value * value)), 5) AS rms, round(max(abs(value)), 4) AS peak FROM events GROUP BY 1, 2""")
def bucket_energy(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id", F.floor(F.col("s") / 43200).alias("bucket")).agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 5).alias("rms"), F.round(F.max(F.abs("value")), 4).alias("peak"))


QUERIES, ORACLE = P.queries, P.oracle
