"""Moments, their features and the state of a library: made-up inputs from events, and the sales tables as jobs, clips and their sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions import moments as mo
from streamlens.operators import library
from streamlens.plans import details
from streamlens.plans.base import EVENTS_SQL, SECONDS, Plans, events, spark_columns, sql_columns
from streamlens.session import table

P = Plans()
_pick = details._pick
_TITLE, _TEXT = ["Elimination", "lobby", "Moment", ""], ["back in the LOBBY", "12 Eliminations in a match", "5 Elimination in a single", "you placed #3", "nice"]
_OCR = ["VICTORY ROYALE", "GAME OVER", "#1 victory", "ammo 30", ""]
_EVENT = ["Elimination", "terminal win", "shop", "boss"]
_REACT = ["reaction burst", "Audio Spike", "laughter"]
MOMENT = [("id", "event_id"), ("title", _pick("event_id", _TITLE)), ("text", _pick("event_id", _TEXT)), ("ocr", _pick("event_id", _OCR + _OCR[:2])), ("ev", _pick("event_id", _EVENT + _EVENT[2:])), ("r1", _pick("event_id", _REACT)), ("r2", _pick("event_id", _REACT + _REACT[:1])), ("tag", _pick("event_id", [*mo.TAGS, "other"])), ("multiple", "CAST(1 + event_id % 5 AS INT)"), ("audio", "value / 20"), ("motion", "CAST(event_id % 7 AS DOUBLE) / 5")]


@P.add(f"""WITH m AS (SELECT {sql_columns(MOMENT)} FROM events), s AS (SELECT *, CASE WHEN ocr <> '' THEN ocr ELSE text END AS seen FROM m),
k AS (SELECT *, CASE WHEN regexp_matches(seen, 'VICTORY\\s*ROYALE|#\\s*1\\s+VICTORY', 'i') OR lower(ev) = 'terminal win' THEN 'win' WHEN lower(title) = 'elimination' OR lower(ev) = 'elimination' THEN 'elimination' WHEN lower(title) = 'lobby' OR regexp_matches(text, '\\blobby\\b', 'i') THEN 'lobby' WHEN regexp_matches(seen, 'GAME OVER|YOU\\s*PLACED\\s*#?\\s*(\\d+)|VICTORY\\s*ROYALE|#\\s*1\\s+VICTORY', 'i') THEN 'terminal' ELSE 'event' END AS kind,
  TRY_CAST(regexp_extract(text, '(\\d+)\\s+Eliminations?\\s+in\\s+a', 1, 'i') AS INT) AS milestone FROM s)
SELECT id, kind, milestone, round(1 + 0.45 * least(multiple - 1, 3) + 0.3 * (contains(lower(r1), 'burst')::INT + contains(lower(r2), 'burst')::INT) + 0.2 * (contains(lower(r1), 'audio spike')::INT + contains(lower(r2), 'audio spike')::INT) + 0.35 * least(audio, 3) + 0.25 * least(motion, 1)
  + CASE tag {" ".join(f"WHEN '{t}' THEN {w}" for t, w in mo.TAGS.items())} ELSE 0 END + CASE WHEN milestone IS NOT NULL THEN 0.15 ELSE 0 END, 6)::DOUBLE AS strength FROM k""")
def moment_kinds(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(*spark_columns(MOMENT))
    ocr = F.filter(F.array("ocr"), lambda x: x != "")
    stone = mo.milestone(F.col("text"))
    strength = mo.moment_strength(F.col("multiple"), F.array("r1", "r2"), F.col("audio"), F.col("motion"), F.array("tag"), stone.isNotNull())
    return m.select("id", mo.moment_kind(F.col("title"), F.col("text"), ocr, F.array("ev")).alias("kind"), stone.alias("milestone"), F.round(strength, 6).alias("strength"))


_SAID = ["Thanks for watching, all", "join my Discord now", "Welcome back chat", "nice shot", "next stream is tomorrow", "no thanks"]
_SPOKEN = [("id", "event_id"), ("text", _pick("event_id", _SAID)), ("start", "CAST(event_id % 1000 AS DOUBLE)"), ("end", "CAST(event_id % 1000 + 20 AS DOUBLE)"), ("length", "1000.0")]


@P.add(f"""WITH s AS (SELECT {sql_columns(_SPOKEN)} FROM events) SELECT id, CASE WHEN contains(lower(text), 'thanks for watching') THEN 'sign_off' WHEN (contains(lower(text), 'join my discord') OR contains(lower(text), 'next stream')) AND (start <= 180 OR "end" >= 820) THEN 'logistics' WHEN contains(lower(text), 'welcome back') AND start <= 180 THEN 'greeting' END AS kind,
CASE WHEN length(text) < 8 THEN '' WHEN length(text) <= 12 THEN text ELSE regexp_replace(regexp_extract(left(text, 13) || CASE WHEN length(text) = 12 THEN ' ' ELSE '' END, '^(.{{0,12}})[ ]', 1), '[ ,;:-]+$', '') END AS shown,
replace(replace(replace(replace(text, 'Thanks', 'Cheers'), 'thanks', 'cheers'), 'shot', 'hit'), 'Welcome', 'Hello') AS rewritten FROM s""")
def spoken_kinds(spark, sf_dir):
    """Sign-offs and greetings by where they are said, texts cut to be shown, and a creator's own words put right."""
    s = table(spark, sf_dir, "events").select(*spark_columns(_SPOKEN))
    return s.select("id", mo.housekeeping(F.col("text"), F.col("start"), F.col("end"), F.lit(1000.0)).alias("kind"), mo.shown_text(F.col("text"), 12).alias("shown"), mo.rewritten(F.col("text"), {"thanks": "cheers", "shot": "hit", "welcome": "hello"}).alias("rewritten"))


_ROW = [("id", "event_id"), ("start", "s"), ("end", "s + event_id % 70"), ("peak", "s + event_id % 60"), ("anchor", "CASE WHEN event_id % 3 = 0 THEN s + event_id % 50 END"), ("auc", "value"), ("peak_value", "value / 25"), ("label", _pick("event_id", ["elimination", "terminal_win", "knock", "x"])), ("moment_type", _pick("event_id", ["story", "funny", "clutch", "x", "rage"])), ("dead_air", "CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 10 AS DOUBLE) / 10 END"), ("agreement", "CAST(event_id % 8 AS DOUBLE) / 8"), ("ps", "s - 5 + event_id % 9"), ("pe", "s + event_id % 80"), ("witness", "CASE WHEN event_id % 5 = 0 THEN s + event_id % 40 END")]


@P.add(f"""WITH r AS (SELECT {sql_columns(_ROW)} FROM {EVENTS_SQL}), f AS (SELECT *, greatest(1, "end" - start) AS d FROM r), x AS (SELECT *, auc / d AS mean, CASE label WHEN 'elimination' THEN 0.8 WHEN 'terminal_win' THEN 1.0 WHEN 'knock' THEN 0.6 ELSE 0 END AS tier, (label = 'terminal_win')::INT AS win, greatest(0, least(1, (peak - start) / d)) AS pp, greatest(0, least(1, (coalesce(anchor, peak) - start) / d)) AS op, coalesce(dead_air, 1) AS dead,
  CASE moment_type WHEN 'story' THEN 0.45 WHEN 'funny' THEN 0.95 WHEN 'clutch' THEN 1.0 WHEN 'rage' THEN 0.75 ELSE 0 END AS kind FROM f),
y AS (SELECT *, 0.28 * least(1, peak_value / 3.0) + 0.24 * least(1, mean / 2.2) + 0.18 * least(1, tier) + 0.14 * least(1, agreement / 0.75) + 0.1 * (1 - least(1, dead)) + 0.06 * greatest(0, 1 - abs(op - 0.68) / 0.68) AS raw FROM x)
SELECT id, round(mean + 1e-9, 5)::DOUBLE AS mean, tier::DOUBLE AS tier, win::DOUBLE AS win, round(pp + 1e-9, 5)::DOUBLE AS peak_place, round(op + 1e-9, 5)::DOUBLE AS payoff_place, kind::DOUBLE AS kind, round(greatest(0.45, least(0.98, CASE WHEN win = 1 THEN greatest(raw, 0.82) ELSE raw END)) + 1e-9, 5)::DOUBLE AS shown,
round(CASE WHEN pe > ps AND peak BETWEEN ps AND pe THEN greatest(0, ps) ELSE greatest(0, start) END, 3)::DOUBLE AS judge_start, round(CASE WHEN pe > ps AND peak BETWEEN ps AND pe THEN pe ELSE greatest(greatest(0, start) + 0.1, "end") END, 3)::DOUBLE AS judge_end FROM y""")
def ranker_features(spark, sf_dir):
    r = events(spark, sf_dir).select(*spark_columns(_ROW))
    f = mo.ranker_features({c: F.col(c) for c in ("start", "end", "peak", "anchor", "auc", "peak_value", "label", "moment_type", "dead_air", "agreement")})
    w = mo.judged_window(F.col("start"), F.col("end"), F.col("ps"), F.col("pe"), F.col("peak"))
    e = lambda c, n: F.round(c + 1e-9, 5).alias(n)
    return r.select("id", e(f["mean_intensity"], "mean"), f["game_tier"].alias("tier"), f["is_win"].alias("win"), e(f["peak_position"], "peak_place"), e(f["payoff_position"], "payoff_place"), f["moment_type"].alias("kind"), e(mo.display_score(f), "shown"), F.round(w["start"], 3).alias("judge_start"), F.round(w["end"].cast("double"), 3).alias("judge_end"))


_LOOKS = [2, 3, 6, 8]
_LOOK = [("id", "event_id"), ("start", "floor(s) % 5000"), ("end", "floor(s) % 5000 + 1 + event_id % 70"), ("peak", "floor(s) % 5000 + user_id % 60 + 0.3"), ("witness", "CASE WHEN event_id % 5 = 0 THEN floor(s) % 5000 + value / 4 END"), ("expected", "CASE WHEN event_id % 3 = 0 THEN floor(s) % 5000 + user_id % 50 END")]


@P.add(f"""WITH r AS (SELECT {sql_columns([(n, f"CAST({e} AS DOUBLE)" if n != "id" else e) for n, e in _LOOK])} FROM {EVENTS_SQL}), n AS (SELECT *, "end" - start AS d, coalesce(witness, expected + 1) AS shown, unnest({_LOOKS}) AS n FROM r),
c AS (SELECT *, CASE WHEN peak BETWEEN start AND "end" THEN peak ELSE start + d * 0.55::DOUBLE END AS centre FROM n),
k AS (SELECT *, unnest(range(0, n)) AS slot FROM c),
w AS (SELECT *, CASE WHEN n > 2 AND slot = least(n - 1, n // 2 + 1) AND shown BETWEEN start AND "end" THEN 'banner' WHEN slot = n // 2 THEN 'peak' WHEN n > 2 AND slot = greatest(1, n // 2 - 1) THEN 'approach' WHEN slot = 0 THEN 'opening' ELSE 'spread' END AS role FROM k),
t AS (SELECT id, n, role, round(greatest(start + least(0.15, d * 0.02::DOUBLE), least("end" - least(0.15, d * 0.02::DOUBLE),
  CASE role WHEN 'banner' THEN shown WHEN 'peak' THEN centre WHEN 'approach' THEN centre - least(1.0, d * 0.08::DOUBLE) WHEN 'opening' THEN start + CASE WHEN n = 2 THEN 0.5 ELSE least(0.5, d * 0.05::DOUBLE) END ELSE start + d * (slot / n::DOUBLE) END)), 3)::DOUBLE AS t FROM w),
l AS (SELECT id, n, list_sort(list({{'t': t, 'role': role}})) AS x FROM t GROUP BY 1, 2),
u AS (SELECT id, n, list_reduce(list_transform(x, lambda v: [v]), lambda acc, v: CASE WHEN v[1].t - acc[len(acc)].t >= 0.05 THEN list_append(acc, v[1]) ELSE acc END) AS x FROM l),
f AS (SELECT id, n, unnest(range(1, len(x) + 1)) AS place, x FROM u) SELECT id, n::INT AS looks, place::INT AS place, x[place].role AS role, x[place].t AS t FROM f""")
def sampled_times(spark, sf_dir):
    """Every look at every window, for several numbers of looks."""
    r = events(spark, sf_dir).select(*spark_columns([(n, f"CAST({e} AS DOUBLE)" if n != "id" else e) for n, e in _LOOK]))
    args = [F.col(c) for c in ("start", "end", "peak", "witness", "expected")]
    looks = F.array(*[F.struct(F.lit(n).alias("looks"), mo.look_times(*args, n).alias("x")) for n in _LOOKS])
    return r.select("id", F.inline(looks)).select("id", "looks", F.posexplode("x").alias("place", "x")).select("id", "looks", (F.col("place") + 1).alias("place"), "x.role", "x.t")


_STRETCH = [("id", "event_id"), ("a", "CAST(floor(value * 4) AS DOUBLE) / 8"), ("b", "CAST(floor(value * 4) AS DOUBLE) / 8 + CAST(user_id % 37 AS DOUBLE) / 8")]


@P.add(f"""WITH r AS (SELECT {sql_columns(_STRETCH)} FROM events), n AS (SELECT *, b - a AS span, floor((b - a - 1.5 + 1e-6) / 0.75)::BIGINT + 1 AS n, 45.0::DOUBLE AS length FROM r), c AS (SELECT *, least(greatest(0, (a + b) / 2 - 0.5), length - 1) AS mid FROM n),
w AS (SELECT id, unnest(CASE WHEN span >= 1.5 THEN list_concat(list_transform(range(0, n), lambda k: {{'s': a + k * 0.75, 'e': a + k * 0.75 + 1.5}}), CASE WHEN a + (n - 1) * 0.75 + 1.5 < b - 0.25 THEN [{{'s': b - 1.5, 'e': b}}] ELSE [] END) WHEN span >= 1 THEN [{{'s': a, 'e': b}}] WHEN span > 0 THEN [{{'s': mid, 'e': mid + 1}}] ELSE [] END) AS x FROM c)
SELECT id, round(x.s, 4)::DOUBLE AS start, round(x.e, 4)::DOUBLE AS "end" FROM w""")
def speech_windows(spark, sf_dir):
    """Every window of every stretch of speech."""
    r = table(spark, sf_dir, "events").select(*spark_columns(_STRETCH))
    x = r.select("id", F.explode(mo.speech_windows(F.col("a"), F.col("b"), F.lit(45.0))).alias("w"))
    return x.select("id", F.round("w.start", 4).alias("start"), F.round("w.end", 4).alias("end"))


#: A judge's answer about an event, in the order payoff, type, verdict, hook, contained; numbers may be out of range, types unknown.
_NUMBER = {"payoff": "value / 40", "hook": "CAST(event_id % 15 - 2 AS DOUBLE) / 8", "contained": "CAST(user_id % 9 AS DOUBLE) / 8"}
_TYPE, _SAYS = _pick("event_id", ["Funny", "story", "odd", "RAGE"]), _pick("user_id", ["POST", "maybe", "skip", "later"])
_WHOLE = f"""concat('{{"payoff": ', CAST({_NUMBER["payoff"]} AS STRING), ', "moment_type": "', {_TYPE}, '", "verdict": "', {_SAYS}, '", "hook_strength": ', CAST({_NUMBER["hook"]} AS STRING), ', "self_contained": ', CAST({_NUMBER["contained"]} AS STRING), '}}')"""


@P.add(f"""WITH j AS (SELECT event_id AS id, event_id % 5 AS form, {", ".join(f"{e} AS {n}" for n, e in _NUMBER.items())}, lower({_TYPE}) AS kind, lower({_SAYS}) AS verdict FROM events), k AS (SELECT *, form <> 3 AND kind <> 'odd' AND verdict <> 'later' AS fine, form <> 2 AS longer FROM j)
SELECT id, CASE WHEN fine THEN CASE WHEN longer THEN greatest(0, least(1, hook)) ELSE 0 END END::DOUBLE AS hook, CASE WHEN fine THEN CASE WHEN longer AND form <> 4 THEN greatest(0, least(1, contained)) ELSE 0 END END::DOUBLE AS contained,
  CASE WHEN fine THEN round(greatest(0, least(1, payoff)), 6) END::DOUBLE AS payoff, CASE WHEN fine THEN kind END AS kind, CASE WHEN fine THEN verdict END AS verdict FROM k""")
def judge_verdicts(spark, sf_dir):
    """A judge's answers, with words around them, broken off behind a field, without an object, out of range or unknown."""
    whole = F.expr(_WHOLE)
    broken = lambda name: F.concat(F.substring_index(whole, f'"{name}', 1), F.lit(f'"{name[:4]}'))
    form = F.col("event_id") % 5
    text = F.when(form == 1, F.concat(F.lit("Sure, here it is: "), whole, F.lit(" done"))).when(form == 2, broken("hook_strength")).when(form == 3, "nothing").when(form == 4, broken("self_contained")).otherwise(whole)
    v = mo.verdict_struct(text, ["funny", "story", "rage"], ["post", "maybe", "skip"])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), v.alias("v")).select("id", "v.hook", "v.contained", F.round("v.payoff", 6).alias("payoff"), "v.kind", "v.verdict")


@P.add("""WITH r AS (SELECT event_id AS id, CAST(event_id % 5 AS DOUBLE) / 10 AS rate, 3600.0::DOUBLE AS length, CAST(event_id % 400 AS DOUBLE) AS elapsed, CAST(event_id % 21 AS DOUBLE) / 20 AS progress, CAST(event_id % 700 AS DOUBLE) AS later FROM events), x AS (SELECT *, rate * length AS expected, CASE WHEN progress > 0.1 AND elapsed > 5 THEN elapsed / progress END AS measured FROM r),
t AS (SELECT *, CASE WHEN measured IS NOT NULL AND expected > 0 THEN 0.5 * measured + 0.5 * expected ELSE coalesce(measured, CASE WHEN expected > 0 THEN expected END) END AS total FROM x) SELECT id, CASE WHEN total IS NOT NULL THEN round(least(greatest(0, total - elapsed) + later, 21600) + 1e-9, 4) END::DOUBLE AS remaining FROM t""")
def job_estimates(spark, sf_dir):
    i = F.col("event_id")
    x = mo.stage_remaining((i % 5).cast("double") / 10, F.lit(3600.0), (i % 400).cast("double"), (i % 21).cast("double") / 20, (i % 700).cast("double"))
    total = F.least(x, F.lit(21600.0))
    known = ((i % 5) > 0) | (((i % 21) / 20 > 0.1) & (i % 400 > 5))
    return table(spark, sf_dir, "events").select(i.alias("id"), F.when(known, F.round(total + 1e-9, 4)).alias("remaining"))


# the library's state


@P.add("""WITH l AS (SELECT l_orderkey AS job, arg_max(l_suppkey, (l_shipdate, l_linenumber, l_suppkey)) AS source, count(*) AS clips, count(DISTINCT l_suppkey)::BIGINT AS sources FROM lineitem GROUP BY 1)
SELECT o_orderkey AS job, coalesce(source, 0)::BIGINT AS source, coalesce(clips, 0)::BIGINT AS clips, coalesce(sources, 0)::BIGINT AS sources, CASE WHEN source % 7 = 0 THEN 'local' WHEN source % 3 = 0 THEN 'restorable' ELSE 'gone' END AS media, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END, strftime(o_orderdate, '%Y-%m-%d')) AS effective,
EXISTS (SELECT 1 FROM orders a JOIN l m ON m.job = a.o_orderkey WHERE m.source = l.source AND a.o_orderstatus = 'P') AS active FROM orders LEFT JOIN l ON l.job = o_orderkey""")
def job_sources(spark, sf_dir):
    """Jobs with the source linked to them last, what is left of its media, their effective date, and whether any job of that source still runs."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_linenumber", "l_suppkey")).alias("source"), F.count("*").alias("clips"), F.count_distinct("l_suppkey").alias("sources"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), "o_orderstatus", "o_orderdate").join(l, "job", "left")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    o = library.availability(o, "source", s.where("source % 7 = 0"), s.where("source % 3 = 0"), "media")
    o = library.with_active(o, "source", o.where("o_orderstatus = 'P'"), "active")
    date = library.effective_date(F.when(F.col("job") % 4 == 0, F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    return o.select("job", F.coalesce("source", F.lit(0)).alias("source"), F.coalesce("clips", F.lit(0)).alias("clips"), F.coalesce("sources", F.lit(0)).alias("sources"), "media", date.alias("effective"), "active")


@P.add("""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS clip, l_linenumber AS event, l_shipdate AS day, l_returnflag AS label FROM lineitem), k AS (SELECT clip % 5000 AS clip, event, max(label) AS label FROM d WHERE NOT (event = 3 AND clip % 2 = 0) GROUP BY 1, 2) SELECT clip, arg_max(label, event) AS label, max(event)::BIGINT AS event FROM k GROUP BY clip""")
def retracted_labels(spark, sf_dir):
    """Decisions of one event taken back for some clips; the decision before them counts again."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.col("l_linenumber").cast("long").alias("event"), F.col("l_returnflag").alias("label"))
    gone = d.where("event = 3 AND row % 2 = 0").select("row", "event")
    left = library.retract(d, gone, ["row", "event"]).groupBy((F.col("row") % 5000).alias("clip"), "event").agg(F.max("label").alias("label"))
    return library.latest(left, ["clip"], "event").select("clip", "label", "event")


@P.add("""WITH p AS (SELECT o_orderkey AS id, o_orderstatus AS label, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders), q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || id), id) AS k FROM p WHERE r <= 300) SELECT id, label FROM q WHERE k <= 3""")
def keep_examples(spark, sf_dir):
    """From the latest 300, three of each label by a seeded order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), "o_orderdate")
    return library.stratified_latest(o, "label", "id", ["o_orderdate", "id"], 300, 3, "7").select("id", "label")


@P.add("""WITH e AS (SELECT event_id, event_type, user_id, (event_id % 3 = 0) AS degraded, props FROM events), s AS (SELECT user_id, event_type, bool_or(degraded) AS any_bad, arg_max(degraded, event_id) AS degraded FROM e GROUP BY 1, 2)
SELECT user_id, count(*)::BIGINT AS judges, bool_or(degraded) AS any_degraded, string_agg(CASE WHEN degraded THEN event_type END, ',' ORDER BY event_type) AS which FROM s GROUP BY 1""")
def judge_health(spark, sf_dir):
    """The latest report of each judge, and whether any of them is degraded."""
    e = events(spark, sf_dir).select("user_id", "event_type", "event_id", (F.col("event_id") % 3 == 0).alias("degraded"))
    last = library.latest(e, ["user_id", "event_type"], "event_id")
    bad = F.array_join(F.array_sort(F.collect_list(F.when(F.col("degraded"), F.col("event_type")))), ",")
    return last.groupBy("user_id").agg(F.count("*").alias("judges"), F.max("degraded").alias("any_degraded"), F.when(F.max("degraded"), bad).alias("which"))


@P.add("""WITH s AS (SELECT event_type AS signal, event_id % 3 AS g, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY g) AS total, row_number() OVER (PARTITION BY g ORDER BY n DESC, signal) AS place FROM s) SELECT g, signal, n::BIGINT AS n, round(n / total::DOUBLE, 6) AS share FROM r WHERE place <= 3""")
def top_signals(spark, sf_dir):
    """Why moments were flagged: the most frequent signals of each group and their shares."""
    s = events(spark, sf_dir).groupBy((F.col("event_id") % 3).alias("g"), F.col("event_type").alias("signal")).agg(F.count("*").alias("n"))
    r = s.withColumn("total", F.sum("n").over(W.partitionBy("g"))).withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(F.desc("n"), "signal")))
    return r.where("place <= 3").select("g", "signal", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@P.add("""WITH i AS (SELECT l_suppkey AS source, o_orderpriority AS session, min(l_orderkey * 10 + l_linenumber) AS first, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1, 2) SELECT source, sum(n)::BIGINT AS items, string_agg(session, ',' ORDER BY first) AS sessions FROM i GROUP BY 1""")
def missing_sources(spark, sf_dir):
    """Items by missing source (no supplier in credit stands for it), with the sessions they come from in the order in which they are first seen."""
    there = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    l = table(spark, sf_dir, "lineitem").join(there, "l_suppkey", "left_anti").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    by = l.groupBy(F.col("l_suppkey").alias("source"), F.col("o_orderpriority").alias("session")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"), F.count("*").alias("n"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "session"))), lambda x: x["session"]), ",")
    return by.groupBy("source").agg(F.sum("n").alias("items"), names.alias("sessions"))


@P.add("""WITH x AS (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders), d AS (SELECT ('0x' || substr(sha256(concat_ws('|', o_custkey, o_orderstatus)), 1, 12))::BIGINT AS h, o_orderstatus, o_totalprice FROM x)
SELECT count(*)::BIGINT AS completed, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS kept, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS passed, count(*) FILTER (o_orderstatus <> 'O')::BIGINT AS decided, round(sum(o_totalprice), 2)::DOUBLE AS seconds, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'O'), 4) AS keep_rate, (sum(h % 1000003))::BIGINT AS revision FROM d""")
def headline_totals(spark, sf_dir):
    """The library's totals, and a revision mark that does not depend on the order of rows."""
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    t = o.agg(F.count("*").alias("completed"), F.count_if(s == "F").alias("kept"), F.count_if(s == "P").alias("passed"), F.count_if(s != "O").alias("decided"), F.round(F.sum("o_totalprice"), 2).alias("seconds"), F.round(100 * F.count_if(s == "F") / F.count_if(s != "O"), 4).alias("keep_rate"), library.revision(F.concat_ws("|", "o_custkey", "o_orderstatus")).alias("revision"))
    return t


@P.add(f"""WITH a AS (SELECT user_id, event_id AS anchor, {SECONDS} + event_id % 50 AS wall, {SECONDS} - 3000 + event_id % 50 AS stream FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, event_id, {SECONDS} AS wall, CASE WHEN event_id % 4 = 0 THEN {SECONDS} - 2990 END AS own FROM events WHERE event_type = 'error'),
n AS (SELECT e.event_id, arg_min(stream + (e.wall - a.wall), (abs(e.wall - a.wall), anchor)) AS est FROM e JOIN a ON a.user_id = e.user_id GROUP BY 1), t AS (SELECT e.user_id, e.event_id, coalesce(own, est) AS t FROM e LEFT JOIN n ON n.event_id = e.event_id), m AS (SELECT *, greatest(0, t - 60000) AS a, t + 20000 AS b FROM t WHERE t >= 0 AND t <= 2500000),
o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m), g AS (SELECT *, sum((reach IS NULL OR a - reach > 12)::INT) OVER (PARTITION BY user_id ORDER BY a, b) AS run FROM o) SELECT user_id, round(min(a), 3)::DOUBLE AS start, round(max(b), 3)::DOUBLE AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, run""")
def marker_regions(spark, sf_dir):
    """Live markers on the stream's clock, by their own position or the nearest clock anchor, as regions with room before and after."""
    e = events(spark, sf_dir)
    a = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("anchor"), (F.col("s") + F.col("event_id") % 50).alias("wall_a"), (F.col("s") - 3000 + F.col("event_id") % 50).alias("stream"))
    m = e.where("event_type = 'error'").select("user_id", "event_id", F.col("s").alias("wall"), F.when(F.col("event_id") % 4 == 0, F.col("s") - 2990).alias("own"))
    x = library.region_plan(m, a, ["user_id"], 60000.0, 20000.0, 12.0, 2500000.0)
    return x.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


QUERIES, ORACLE = P.queries, P.oracle
