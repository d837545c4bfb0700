"""Evidence packs, montages, pools, segments and second looks: purchases and clicks stand for clips and lines, events for signals and moments."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions import intervals as fi
from streamlens.operators import candidates, editorial, intervals, packs
from streamlens.plans import clips, details, spans
from streamlens.plans.base import EVENTS_SQL, SECONDS, Plans, events, spark_columns, sql_columns

P = Plans()
_CL = spans._CL
_C = lambda spark, sf_dir: spans._spans(spark, sf_dir, *spans.CLIPS)
_L = lambda spark, sf_dir: spans._spans(spark, sf_dir, *spans.LINES)
_OVER = "greatest(0, least(l_end, c_end) - greatest(l_start, c_start))"


@P.add(f"""WITH {_CL}, j AS (SELECT l_id, c_id, {_OVER} / greatest(1, l_end - l_start) * 4 + 1 / (1 + abs((c_start + c_end) / 2 - (l_start + l_end) / 2)) AS score, {_OVER} AS o, abs((c_start + c_end) / 2 - (l_start + l_end) / 2) AS far FROM l JOIN c ON c.user_id = l.user_id)
SELECT l_id AS entry, arg_min(c_id, (-round(score, 12), c_id)) AS candidate, round(max(score), 6)::DOUBLE AS score FROM j WHERE o > 0 OR far <= 4000 GROUP BY l_id""")
def matching_candidates(spark, sf_dir):
    e = _L(spark, sf_dir).select("user_id", F.col("l_id").alias("entry"), F.col("l_start").alias("a"), F.col("l_end").alias("b"))
    c = _C(spark, sf_dir).select("user_id", F.col("c_id").alias("candidate"), F.col("c_start").alias("c"), F.col("c_end").alias("d"), ((F.col("c_start") + F.col("c_end")) / 2).alias("peak"))
    return packs.matching_candidate(e, c, ["user_id"], 4000.0, 40000.0).select("entry", "candidate", F.round("score", 6).alias("score"))


_OCR = ["VICTORY", "40 ammo", "Elimination", "shop", "be quiet now", "Boss Fight ahead"]
SIGNAL = [("user_id", "user_id"), ("t", "s"), ("spike", "CASE WHEN event_id % 4 = 0 THEN value / 50 END"), ("motion", "CAST(event_id % 9 AS DOUBLE) / 9"), ("phrase", f"CASE WHEN event_id % 5 <> 0 THEN {details._pick('event_id', _OCR)} END"), ("confidence", "CAST(event_id % 10 AS DOUBLE) / 10"), ("event", "event_id % 6 IN (0, 2, 5)")]


@P.add(f"""WITH {_CL}, g AS (SELECT {sql_columns(SIGNAL)} FROM {EVENTS_SQL}), j AS (SELECT c_id, c_start, c_end, g.* FROM c JOIN g ON g.user_id = c.user_id AND t BETWEEN c_start - 30000 AND c_end + 30000),
s AS (SELECT c_id, count(*) AS samples, count(spike) AS spikes, coalesce(max(spike), 0) AS top_spike, avg(motion) AS mean_motion, max(motion) AS top_motion FROM j GROUP BY 1),
p AS (SELECT c_id, lower(phrase) AS key, min(phrase) AS phrase, count(*) AS n, max(confidence) AS confidence, min(abs(t - (c_start + c_end) / 2)) AS far, bool_or(event) AS event FROM j WHERE phrase IS NOT NULL GROUP BY 1, 2),
r AS (SELECT p.*, row_number() OVER (PARTITION BY c_id ORDER BY round(confidence + CASE WHEN event THEN 1.5 ELSE 0 END + least(0.45, length(phrase) / 100.0::DOUBLE) + 0.25::DOUBLE / (1 + far) - CASE WHEN n / samples::DOUBLE > 0.6 AND NOT event THEN 0.35 ELSE 0 END, 9) DESC, far, key) AS place FROM p JOIN s USING (c_id)),
o AS (SELECT c_id, string_agg(phrase, '; ' ORDER BY place) AS ocr FROM r WHERE place <= 4 GROUP BY 1)
SELECT c.c_id AS target, coalesce(samples, 0)::BIGINT AS samples, coalesce(spikes, 0)::BIGINT AS spikes, round(coalesce(top_spike, 0), 5)::DOUBLE AS top_spike, round(coalesce(mean_motion, 0) + 1e-9, 5)::DOUBLE AS mean_motion, round(coalesce(top_motion, 0), 5)::DOUBLE AS top_motion, coalesce(ocr, '') AS ocr FROM c LEFT JOIN s USING (c_id) LEFT JOIN o USING (c_id)""")
def evidence_packs(spark, sf_dir):
    t = _C(spark, sf_dir).select("user_id", F.col("c_id").alias("target"), F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    x = packs.signal_packs(t, events(spark, sf_dir).select(*spark_columns(SIGNAL)), ["user_id"], 30000.0, 4, 100000.0)
    return x.select("target", "samples", "spikes", F.round("top_spike", 5).alias("top_spike"), F.round(F.col("mean_motion") + 1e-9, 5).alias("mean_motion"), F.round("top_motion", 5).alias("top_motion"), F.array_join("ocr", "; ").alias("ocr"))


_CHAT = [("user_id", "user_id"), ("ws", "s"), ("we", "s + 15000"), ("messages", "event_id % 9"), ("emotes", "event_id % 5"), ("intents", "CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END")]


@P.add(f"""WITH {_CL}, w AS (SELECT {sql_columns(_CHAT)} FROM {EVENTS_SQL} WHERE event_type = 'view'), s AS (SELECT c_id, sum(messages) AS messages, sum(emotes) AS emotes, sum(intents) AS intents FROM c JOIN w ON w.user_id = c.user_id AND ws < c_end + 3000 AND we > c_start - 3000 GROUP BY 1)
SELECT c_id AS target, messages::BIGINT AS messages, emotes::BIGINT AS emotes, intents::BIGINT AS intents, array_to_string(list_filter([CASE WHEN messages > 0 THEN 'chat burst' END, CASE WHEN messages > 0 AND emotes >= 6 THEN 'chat emote burst' END, CASE WHEN messages > 0 AND intents > 0 THEN 'viewer clip request' END], lambda v: v IS NOT NULL), ',') AS reactions FROM s""")
def chat_packs(spark, sf_dir):
    t = _C(spark, sf_dir).select("user_id", F.col("c_id").alias("target"), F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    w = events(spark, sf_dir).where("event_type = 'view'").select(*spark_columns(_CHAT))
    return packs.chat_packs(t, w, ["user_id"], 3000.0, 40000.0).select("target", "messages", "emotes", F.col("intents").cast("long").alias("intents"), F.array_join("reactions", ",").alias("reactions"))


@P.add(f"""WITH {_CL}, f AS (SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY l_value DESC, l_start, l_id) AS r FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = l.user_id AND {_OVER} >= 0.5 * (l_end - l_start) AND c_start <= l_end AND c_end >= l_start)) SELECT l_id AS id FROM f WHERE r <= 4""")
def standalone_anchors(spark, sf_dir):
    """Extra anchors that no clip covers, the strongest few of each recording."""
    e = _L(spark, sf_dir).select("user_id", F.col("l_id").alias("id"), F.col("l_start").alias("a"), F.col("l_end").alias("b"), F.col("l_value").alias("strength"))
    c = _C(spark, sf_dir).select("user_id", F.col("c_start").alias("c"), F.col("c_end").alias("d"))
    return packs.unmatched(e, c, ["user_id"], 4, 0.5, 40000.0).select("id")


@P.add(f"""WITH {_CL}, j AS (SELECT l.user_id, l_id, c_id, c_start, {_OVER} / greatest(0.1, l_end - l_start) AS part FROM l JOIN c ON c.user_id = l.user_id AND c_start <= l_end AND c_end >= l_start), b AS (SELECT l_id, arg_min(c_id, (-round(part, 9), c_start, c_id)) AS clip FROM j WHERE part >= 0.5 GROUP BY 1),
m AS (SELECT l.user_id, l.l_id, l_start, clip, round(l_value / 20, 4) + CASE WHEN clip % 3 = 0 THEN 1.0 WHEN clip % 3 = 1 THEN -0.5 ELSE 0 END AS strength FROM l LEFT JOIN b ON b.l_id = l.l_id), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, clip ORDER BY strength DESC, l_start, l_id) AS r FROM m)
SELECT l_id AS moment, clip, round(strength, 4)::DOUBLE AS strength FROM r WHERE clip IS NULL OR r = 1""")
def claimed_clips(spark, sf_dir):
    m = _L(spark, sf_dir).select("user_id", F.col("l_id").alias("moment"), F.col("l_start").alias("a"), F.col("l_end").alias("b"), F.round(F.col("l_value") / 20, 4).alias("strength"))
    c = _C(spark, sf_dir).select("user_id", F.col("c_id").alias("clip"), F.col("c_start").alias("c"), F.col("c_end").alias("d"), (F.col("c_id") % 3 == 0).alias("kept"), (F.col("c_id") % 3 == 1).alias("passed"))
    return packs.claimed_clips(m, c, ["user_id"], 0.5, 40000.0).select("moment", "clip", F.round("strength", 4).alias("strength"))


@P.add(f"""WITH RECURSIVE m AS (SELECT user_id, event_id AS moment, {SECONDS} AS t, value AS strength, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, {SECONDS}, event_id) AS i FROM events WHERE event_type IN ('click', 'view')),
k AS (SELECT user_id, i, moment, t, TRUE AS ok, [t] AS kept FROM m WHERE i = 1 UNION ALL SELECT m.user_id, m.i, m.moment, m.t, len(k.kept) < 6 AND len(list_filter(k.kept, lambda x: abs(x - m.t) < 60000)) = 0,
  CASE WHEN len(k.kept) < 6 AND len(list_filter(k.kept, lambda x: abs(x - m.t) < 60000)) = 0 THEN list_append(k.kept, m.t) ELSE k.kept END FROM k JOIN m ON m.user_id = k.user_id AND m.i = k.i + 1)
SELECT user_id, moment, (row_number() OVER (PARTITION BY user_id ORDER BY (i <> 1)::INT, t, moment) - 1)::INT AS position, round(greatest(0, t - 30000), 3)::DOUBLE AS start FROM k WHERE ok""")
def montage_cuts(spark, sf_dir):
    m = events(spark, sf_dir).where("event_type IN ('click', 'view')").select("user_id", F.col("event_id").alias("moment"), F.col("s").alias("at"), F.col("value").alias("strength"))
    return packs.montage(m, ["user_id"], 60000.0, 380000.0, 12).select("user_id", "moment", "position", F.round("start", 3).alias("start"))


@P.add(f"""WITH h AS (SELECT user_id, {SECONDS} AS t, event_id % 4 + 1 AS score, CASE WHEN event_type = 'error' THEN 'credits' ELSE 'menu' END AS kind FROM events WHERE event_type IN ('error', 'signup')),
g AS (SELECT *, sum(CASE WHEN t - before <= 60000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, kind ORDER BY t) AS run FROM (SELECT *, lag(t) OVER (PARTITION BY user_id, kind ORDER BY t) AS before FROM h)),
r AS (SELECT user_id, kind, greatest(0, min(t) - 6) AS a, max(t) + 18 AS b, count(*) AS n FROM g GROUP BY user_id, kind, run HAVING sum(score) >= 6 OR count(*) >= 2),
o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), u AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS run FROM o)
SELECT user_id, round(min(a), 3)::DOUBLE AS start, round(max(b), 3)::DOUBLE AS "end", string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds, sum(n)::BIGINT AS n FROM u GROUP BY user_id, run""")
def credit_regions(spark, sf_dir):
    h = events(spark, sf_dir).where("event_type IN ('error', 'signup')").select("user_id", F.col("s").alias("t"), (F.col("event_id") % 4 + 1).alias("score"), F.when(F.col("event_type") == "error", "credits").otherwise("menu").alias("kind"))
    return packs.credit_regions(h, ["user_id"], 60000.0).select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "kinds", "n")


@P.add(f"""WITH {_CL}, j AS (SELECT l_id, c_id, CASE WHEN l_end > l_start THEN {_OVER} / (l_end - l_start) ELSE 0 END AS part FROM l JOIN c ON c.user_id = l.user_id AND c_start <= l_end AND c_end >= l_start) SELECT l_id AS id, arg_min(c_id, (-round(part, 9), -(c_id % 7), c_id)) AS region FROM j WHERE part >= 0.5 GROUP BY l_id""")
def region_classes(spark, sf_dir):
    l = _L(spark, sf_dir).select("user_id", F.col("l_id").alias("id"), F.col("l_start").alias("a"), F.col("l_end").alias("b"))
    c = _C(spark, sf_dir).select("user_id", F.col("c_id").alias("region"), F.col("c_start").alias("c"), F.col("c_end").alias("d"), (F.col("c_id") % 7).alias("n"))
    return packs.region_of(l, c, ["user_id"], 0.5, 40000.0)


@P.add(f"""WITH {_CL}, j AS (SELECT l_id, c_id, {_OVER} / least(l_end - l_start, c_end - c_start) AS cover, {_OVER} / ((l_end - l_start) + (c_end - c_start) - {_OVER}) AS iou FROM l JOIN c ON c.user_id = l.user_id AND c_start <= l_end AND c_end >= l_start)
SELECT l_id AS window_id, arg_min(c_id, (-round(cover, 9), -round(iou, 9), c_id)) AS candidate, round(max(cover), 6)::DOUBLE AS cover FROM j WHERE cover >= 0.5 GROUP BY l_id""")
def window_matches(spark, sf_dir):
    w = _L(spark, sf_dir).select("user_id", F.col("l_id").alias("window"), F.col("l_start").alias("a"), F.col("l_end").alias("b"))
    c = _C(spark, sf_dir).select("user_id", F.col("c_id").alias("candidate"), F.col("c_start").alias("c"), F.col("c_end").alias("d"))
    return packs.best_window(w, c, ["user_id"], 0.5, 40000.0).select(F.col("window").alias("window_id"), "candidate", F.round("cover", 6).alias("cover"))


_LINE = [("l_id", "event_id"), ("text", details._pick("event_id", details.MESSAGES))]


@P.add(f"""WITH {_CL}, t AS (SELECT {sql_columns(_LINE)} FROM events), j AS (SELECT c_id, l.l_id, l_start, text, length(text) AS n FROM c JOIN l ON l.user_id = c.user_id AND l_start < c_end AND l_end > c_start JOIN t ON t.l_id = l.l_id WHERE length(text) > 3)
SELECT c_id, arg_min(text, (-n, l_start, l_id)) AS title, round(max(l_start), 3)::DOUBLE AS last_line FROM j GROUP BY c_id""")
def spoken_titles(spark, sf_dir):
    """The longest line that is spoken in each clip."""
    t = events(spark, sf_dir).select(*spark_columns(_LINE))
    j = intervals.range_join(_C(spark, sf_dir), _L(spark, sf_dir), ["user_id"], ("c_start", "c_end"), ("l_start", "l_end"), 0.0, 40000.0, strict=True).join(t, "l_id").where(F.length("text") > 3)
    return j.groupBy("c_id").agg(F.min_by("text", F.struct((-F.length("text")).alias("n"), "l_start", "l_id")).alias("title"), F.round(F.max("l_start"), 3).alias("last_line"))


@P.add(f"""WITH {_CL}, s AS (SELECT c_id, max(l_value) AS top FROM c JOIN l ON l.user_id = c.user_id AND l_start < c_end AND l_end > c_start GROUP BY 1), e AS (SELECT user_id, event_id, {SECONDS} AS t FROM events WHERE event_type = 'view'), x AS (SELECT event_id, min(l_value) AS low, max(l_value) AS high FROM e JOIN l ON l.user_id = e.user_id AND t >= l_start AND t < l_end GROUP BY 1)
SELECT 'span' AS what, c_id AS id, round(top, 4)::DOUBLE AS low, round(top, 4)::DOUBLE AS high FROM s UNION ALL SELECT 'frame', event_id, round(low, 4)::DOUBLE, round(high, 4)::DOUBLE FROM x""")
def voice_similarity(spark, sf_dir):
    """Greatest similarity of the windows over each span; least and greatest over the windows that hold each frame."""
    l = _L(spark, sf_dir)
    s = intervals.range_join(_C(spark, sf_dir), l, ["user_id"], ("c_start", "c_end"), ("l_start", "l_end"), 0.0, 40000.0, strict=True).groupBy(F.col("c_id").alias("id")).agg(F.round(F.max("l_value"), 4).alias("low"), F.round(F.max("l_value"), 4).alias("high"))
    e = events(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", F.col("s").alias("t"))
    x = intervals.points_in(e, l, ["user_id"], "t", ("l_start", "l_end"), 0.0, 40000.0, closed=False).groupBy(F.col("event_id").alias("id")).agg(F.round(F.min("l_value"), 4).alias("low"), F.round(F.max("l_value"), 4).alias("high"))
    return s.select(F.lit("span").alias("what"), "id", "low", "high").unionByName(x.select(F.lit("frame").alias("what"), "id", "low", "high"))


@P.add(f"""WITH {clips._CANDIDATES}, s AS (SELECT user_id, avg(peak_value) AS peak, avg(face_max) AS face, avg(voice) AS voice, avg((startle >= 0.45)::INT) AS startled, avg(is_event::INT) AS ev, coalesce(avg((moment_type = 'story')::INT) FILTER (v <> ''), 0) AS story, coalesce(avg((moment_type IN ('funny', 'fail', 'rage'))::INT) FILTER (v <> ''), 0) AS comic,
  coalesce(avg((verbal_payoff AND context_complete AND NOT routine_only)::INT) FILTER (v <> ''), 0) AS verbal FROM evidence GROUP BY 1),
x AS (SELECT *, (CASE WHEN peak < 1.35 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN story >= 0.2 THEN 2 ELSE 0 END) + (CASE WHEN verbal >= 0.15 THEN 1.5 ELSE 0 END) + (CASE WHEN ev < 0.08 AND peak < 1.6 THEN 0.75 ELSE 0 END) AS n,
  (CASE WHEN face >= 0.12 OR startled >= 0.05 THEN 1.5::DOUBLE ELSE 0 END) + (CASE WHEN peak >= 1.8 THEN 1.25 ELSE 0 END) + (CASE WHEN comic >= 0.2 THEN 2 ELSE 0 END) + (CASE WHEN voice >= 0.25 AND face >= 0.08 THEN 0.75 ELSE 0 END) AS h,
  (CASE WHEN ev >= 0.1 THEN 2.0::DOUBLE ELSE 0 END) + (CASE WHEN peak BETWEEN 1 AND 2.2 AND comic < 0.25 THEN 0.75 ELSE 0 END) AS m FROM s),
y AS (SELECT *, greatest(n, h, m) AS top, list_sort([n, h, m])[2] AS second FROM x)
SELECT user_id, CASE WHEN top < 0.75 THEN 'competitive_mixed' WHEN n = top THEN 'narrative' WHEN h = top THEN 'chaos_comedy' ELSE 'competitive_mixed' END AS shape, round(CASE WHEN top < 0.75 THEN 0.25 ELSE least(1, 0.35 + (top - second) * 0.25 + top * 0.15) END, 3)::DOUBLE AS confidence, array_to_string(list_filter([CASE WHEN peak < 1.35 THEN 'low_mean_peak' END, CASE WHEN story >= 0.2 THEN 'story_moment_density' END, CASE WHEN verbal >= 0.15 THEN 'verbal_complete_density' END,
  CASE WHEN ev < 0.08 AND peak < 1.6 THEN 'sparse_ocr_events' END, CASE WHEN face >= 0.12 OR startled >= 0.05 THEN 'face_or_startle_density' END, CASE WHEN peak >= 1.8 THEN 'high_mean_peak' END, CASE WHEN comic >= 0.2 THEN 'funny_fail_density' END, CASE WHEN voice >= 0.25 AND face >= 0.08 THEN 'voice_face_reaction' END,
  CASE WHEN ev >= 0.1 THEN 'ocr_event_density' END, CASE WHEN peak BETWEEN 1 AND 2.2 AND comic < 0.25 THEN 'mid_arousal_band' END, CASE WHEN top < 0.75 THEN 'default_low_evidence' END], lambda x: x IS NOT NULL), ',') AS evidence FROM y""")
def content_shapes(spark, sf_dir):
    x = editorial.with_evidence(candidates.with_score(clips._candidates(spark, sf_dir)))
    return packs.content_shape(x, ["user_id"]).select("user_id", "shape", F.round("confidence", 3).alias("confidence"), F.array_join("evidence", ",").alias("evidence"))


_TRACE = [("user_id", "user_id"), ("id", "event_id"), ("start", "s"), ("end", "s + 9000 * (1 + event_id % 4)"), ("disposition", "CASE event_id % 5 WHEN 0 THEN 'selected' WHEN 1 THEN 'clip_ceiling' WHEN 2 THEN 'editorial_overflow_cutoff' WHEN 3 THEN 'selected_temporal_rescue' ELSE 'suppressed' END"), ("group", "CASE WHEN event_id % 4 <> 0 THEN concat('g', CAST(event_id % 60 AS VARCHAR(9))) END"), ("ranker", "CASE WHEN event_id % 3 <> 0 THEN value END"), ("rank", "event_id % 97"), ("consensus", "event_id % 2 = 0")]


@P.add(f"""WITH t AS (SELECT {sql_columns(_TRACE)} FROM {EVENTS_SQL}), p AS (SELECT *, CASE WHEN disposition = 'clip_ceiling' THEN 0 WHEN disposition = 'editorial_overflow_cutoff' AND consensus THEN 1 END AS tier FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, (ranker IS NULL)::INT, CASE WHEN ranker IS NOT NULL THEN -ranker ELSE rank::DOUBLE END, rank, start, id) AS n FROM p WHERE tier IS NOT NULL), d AS (SELECT * FROM t WHERE disposition LIKE 'selected%'),
l AS (SELECT * FROM o WHERE n <= 12 AND NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = o.user_id AND d."group" = o."group") AND NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = o.user_id AND least(d."end", o."end") - greatest(d.start, o.start) >= 0.6 * (o."end" - o.start))),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, coalesce("group", id::VARCHAR) ORDER BY n) AS first FROM l) SELECT user_id, id, (row_number() OVER (PARTITION BY user_id ORDER BY n))::INT AS place FROM f WHERE first = 1""")
def second_look_cards(spark, sf_dir):
    t = events(spark, sf_dir).select(*spark_columns(_TRACE))
    return packs.second_look(t, ["user_id"], 12, 0.6, 40000.0).select("user_id", "id", "place")


@P.add(f"""WITH c AS (SELECT user_id, event_id AS id, {SECONDS} AS s, value, value * (1 + event_id % 3) AS potential, event_id % 11 = 0 AS anchor FROM events), a AS (SELECT *, CASE WHEN anchor AND row_number() OVER (PARTITION BY user_id, anchor ORDER BY potential DESC, id) <= 12 THEN 'anchor' END AS r1 FROM c),
b AS (SELECT *, count(r1) OVER (PARTITION BY user_id) AS n1 FROM a), b2 AS (SELECT *, coalesce(r1, CASE WHEN row_number() OVER (PARTITION BY user_id, r1 IS NULL ORDER BY value DESC, id) <= 4 - n1 THEN 'signals_challenger' END) AS r2 FROM b),
d AS (SELECT *, count(r2) OVER (PARTITION BY user_id) AS n2 FROM b2), d2 AS (SELECT *, coalesce(r2, CASE WHEN row_number() OVER (PARTITION BY user_id, r2 IS NULL ORDER BY potential DESC, id) <= 6 - n2 THEN 'raw_challenger' END) AS r3 FROM d),
e AS (SELECT *, 12 - count(r3) OVER (PARTITION BY user_id) AS slots, max(s + 100) OVER (PARTITION BY user_id) AS length FROM d2), e2 AS (SELECT *, CASE WHEN slots > 0 THEN least(slots - 1, greatest(0, floor((s + 50) / length * slots))) END AS bin FROM e),
g AS (SELECT *, coalesce(r3, CASE WHEN bin IS NOT NULL AND row_number() OVER (PARTITION BY user_id, r3 IS NULL, bin ORDER BY potential DESC, id) = 1 THEN 'temporal' END) AS r4 FROM e2), h AS (SELECT *, count(r4) OVER (PARTITION BY user_id) AS n4 FROM g),
k AS (SELECT *, coalesce(r4, CASE WHEN row_number() OVER (PARTITION BY user_id, r4 IS NULL ORDER BY potential DESC, id) <= 12 - n4 THEN 'global_fill' END) AS r5 FROM h) SELECT user_id, id, r5 AS reason FROM k WHERE r5 IS NOT NULL""")
def judge_pool(spark, sf_dir):
    c = events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), (F.col("s") + 100).alias("end"), F.col("s"), F.col("value").alias("signal"), (F.col("value") * (1 + F.col("event_id") % 3)).alias("potential"))
    return packs.budgeted_pool(c, ["user_id"], 12, F.col("id") % 11 == 0, "signal", "potential", F.col("s") + 50)


_GAME = [("user_id", "user_id"), ("t", "s"), ("game", "CASE WHEN floor(s / 500000) % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'b' ELSE 'a' END ELSE CASE WHEN event_id % 4 = 0 THEN 'a' ELSE 'b' END END"), ("phrase", "event_id % 5")]


@P.add(f"""WITH RECURSIVE h AS (SELECT {sql_columns(_GAME)} FROM {EVENTS_SQL} WHERE event_type <> 'view'), u AS (SELECT user_id, max(s) AS length FROM {EVENTS_SQL} GROUP BY 1), o AS (SELECT user_id, length, unnest(range(0, greatest(1, ceil(length / 86400)::BIGINT)))::INT AS hop FROM u),
n AS (SELECT o.user_id, hop, game, count(DISTINCT phrase) AS n FROM o JOIN h ON h.user_id = o.user_id AND t >= hop * 86400 AND t < hop * 86400 + 172800 GROUP BY 1, 2, 3), q AS (SELECT user_id, hop, max(n) AS top, sum(n) AS total, count(*) AS games FROM n GROUP BY 1, 2),
v AS (SELECT n.user_id, n.hop, max(game) AS game, count(*) AS leaders, max(top) AS top, max(total) AS total FROM n JOIN q ON q.user_id = n.user_id AND q.hop = n.hop AND n.n = top GROUP BY 1, 2),
w AS (SELECT o.user_id, o.hop, length, CASE WHEN leaders = 1 AND top >= 2 AND top >= 0.4 * total THEN game ELSE 'generic' END AS game FROM o LEFT JOIN v ON v.user_id = o.user_id AND v.hop = o.hop),
k AS (SELECT user_id, hop, length, game AS now, '' AS nx, 0 AS streak FROM w WHERE hop = 0 UNION ALL SELECT w.user_id, w.hop, w.length, CASE WHEN w.game <> k.now AND CASE WHEN w.game = k.nx THEN k.streak + 1 ELSE 1 END >= 2 THEN w.game ELSE k.now END,
  CASE WHEN w.game = k.now OR CASE WHEN w.game = k.nx THEN k.streak + 1 ELSE 1 END >= 2 THEN '' ELSE w.game END, CASE WHEN w.game = k.now OR CASE WHEN w.game = k.nx THEN k.streak + 1 ELSE 1 END >= 2 THEN 0 ELSE CASE WHEN w.game = k.nx THEN k.streak + 1 ELSE 1 END END FROM k JOIN w ON w.user_id = k.user_id AND w.hop = k.hop + 1),
r AS (SELECT *, sum((now IS DISTINCT FROM before)::INT) OVER (PARTITION BY user_id ORDER BY hop) AS run FROM (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY hop) AS before FROM k)), g AS (SELECT user_id, run, length, min(now) AS game, min(hop) AS a, count(*) AS n FROM r GROUP BY 1, 2, 3),
b AS (SELECT user_id, length, a, CASE WHEN game = 'generic' AND n <= 1 AND lag(game) OVER o <> 'generic' AND lag(game) OVER o = lead(game) OVER o THEN lag(game) OVER o ELSE game END AS game FROM g WINDOW o AS (PARTITION BY user_id ORDER BY a)),
j AS (SELECT *, sum((game IS DISTINCT FROM before)::INT) OVER (PARTITION BY user_id ORDER BY a) AS run FROM (SELECT *, lag(game) OVER (PARTITION BY user_id ORDER BY a) AS before FROM b)), f AS (SELECT user_id, length, min(game) AS game, min(a) AS a FROM j GROUP BY user_id, length, run)
SELECT user_id, round(a * 86400, 3)::DOUBLE AS start, round(coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a) * 86400, length), 3)::DOUBLE AS "end", game FROM f""")
def game_segments(spark, sf_dir):
    e = events(spark, sf_dir)
    hits = e.where("event_type <> 'view'").select(*spark_columns(_GAME))
    bounds = e.groupBy("user_id").agg(F.max("s").alias("length"))
    x = packs.game_segments(hits, bounds, ["user_id"], 172800.0, 86400.0)
    return x.select("user_id", F.round(F.col("start").cast("double"), 3).alias("start"), F.round(F.col("end").cast("double"), 3).alias("end"), "game")


#: DuckDB: the union of a list of spans, in order of start, under a gap and a bound.
_UNION = """list_reduce(list_transform(list_sort({x}), lambda v: [{{'a': v.a, 'b': least(v.b, v.a + 90000)}}]), lambda acc, v: CASE WHEN v[1].a <= acc[len(acc)].b + 3600 AND greatest(v[1].b, acc[len(acc)].b) - acc[len(acc)].a <= 90000
  THEN list_append(acc[:len(acc) - 1], {{'a': acc[len(acc)].a, 'b': greatest(v[1].b, acc[len(acc)].b)}}) ELSE list_append(acc, v[1]) END)"""
_LENGTH = "list_sum(list_transform({x}, lambda v: v.b - v.a))"


@P.add(f"""WITH RECURSIVE {spans._sql(*spans.CLIPS)}, {spans._sql(*spans.LINES)}, f AS (SELECT user_id, list({{'a': c_start, 'b': c_end}}) AS x FROM c GROUP BY 1), base AS (SELECT user_id, {_UNION.format(x="x")} AS chosen FROM f),
o AS (SELECT user_id, l_start AS a, l_end AS b, row_number() OVER (PARTITION BY user_id ORDER BY l_start, l_end) AS i FROM l),
k AS (SELECT user_id, 0::BIGINT AS i, chosen, greatest(600000, {_LENGTH.format(x="chosen")}) AS room FROM base
 UNION ALL SELECT user_id, i, CASE WHEN {_LENGTH.format(x="tried")} <= room + 1e-6 THEN tried ELSE chosen END, room FROM (SELECT o.user_id, o.i, k.chosen, k.room, {_UNION.format(x="list_append(k.chosen, {'a': o.a, 'b': o.b})")} AS tried FROM k JOIN o ON o.user_id = k.user_id AND o.i = k.i + 1)),
d AS (SELECT user_id, arg_max(chosen, i) AS chosen FROM k GROUP BY 1), s AS (SELECT user_id, unnest(chosen) AS x FROM d)
SELECT user_id, round(x.a, 3)::DOUBLE AS start, round(x.b, 3)::DOUBLE AS "end" FROM s UNION ALL SELECT user_id, round(a, 3), round(b, 3) FROM o WHERE user_id NOT IN (SELECT user_id FROM base)""")
def priority_regions(spark, sf_dir):
    c = _C(spark, sf_dir).select("user_id", F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    l = _L(spark, sf_dir).select("user_id", F.col("l_start").alias("start"), F.col("l_end").alias("end"))
    x = packs.priority_regions(c, l, ["user_id"], 600000.0, 3600.0, 90000.0)
    return x.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


QUERIES, ORACLE = P.queries, P.oracle
