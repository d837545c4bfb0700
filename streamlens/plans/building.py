"""Building candidates: events stand for frames of a recording (their user), purchases for windows, with spans of hours instead of seconds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions import moments
from streamlens.operators import windows as win
from streamlens.plans import details
from streamlens.plans.base import EVENTS_SQL, Plans, events, spark_columns, sql_columns
from streamlens.session import table

P = Plans()
DAY = 86400.0


def _part(step: int, of: int) -> str:
    return f"CAST(event_id % {step} AS DOUBLE) / {of}"


FRAME = [
    ("user_id", "user_id"), ("id", "event_id"), ("t", "s"), ("score", "value / 40"), ("rms", "value / 100"), ("present", "event_id % 3 <> 0"), ("face", _part(31, 31)), ("voice", _part(19, 30)), ("speech", _part(11, 30)), ("burst", _part(13, 60)),
    ("chat", "CAST(event_id % 7 AS DOUBLE)"), ("motion", _part(17, 60)), ("game_audio", _part(29, 30)), ("loud_onset", _part(23, 23)), ("startle", _part(37, 50)), ("game_evidence", "CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0.0 END"),
    ("pitch", "CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(event_id % 200 AS DOUBLE) END"), ("label", "event_type"), ("evidence", _part(6, 6)),
]
WINDOW = [("user_id", "user_id"), ("id", "event_id"), ("start", "s - 40000"), ("end", "s + 60000 + 20000 * (event_id % 4)"), ("pivot", "s"), ("peak", "s + 5000"), ("anchor", "s")]
_FW = f"f AS (SELECT {sql_columns(FRAME)} FROM {EVENTS_SQL}), w AS (SELECT {sql_columns(WINDOW)} FROM {EVENTS_SQL} WHERE event_type = 'purchase')"


#: The same frames, where some recordings have no chat and others no motion track.
PART_FRAME = [(n, {"chat": f"CASE WHEN user_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE {e} END", "motion": f"CASE WHEN user_id % 4 = 1 THEN CAST(0 AS DOUBLE) ELSE {e} END"}.get(n, e)) for n, e in FRAME]
_PART_FW = f"f AS (SELECT {sql_columns(PART_FRAME)} FROM {EVENTS_SQL}), w AS (SELECT {sql_columns(WINDOW)} FROM {EVENTS_SQL} WHERE event_type = 'purchase')"


def _frames(spark, sf_dir):
    return events(spark, sf_dir).select(*spark_columns([(n, e if e != "0.0" else e) for n, e in FRAME])).withColumn("game_evidence", F.col("game_evidence").cast("double")).withColumn("pitch", F.col("pitch").cast("double"))


def _windows(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'purchase'").select(*spark_columns(WINDOW))


_STATS = ["face", "face_max", "voice", "speech", "chat", "motion", "burst", "loud_onset", "startle", "game_audio", "game", "lead", "settle", "dead_air", "hook_energy", "hook_burst", "hook_chat", "auc"]
_ON = {"face": "present AND face > 0", "voice": "TRUE", "speech": "speech > 0", "burst": "burst > 0", "chat": "chat > 0", "motion": "motion > 0"}


@P.add(f"""WITH {_PART_FW}, j AS (SELECT w.id, w.start, w."pivot", f.* EXCLUDE (id, user_id) FROM w JOIN f ON f.user_id = w.user_id AND t BETWEEN w.start AND w."end"),
s AS (SELECT id, coalesce(avg(face) FILTER (present), 0) AS face, coalesce(max(face) FILTER (present), 0) AS face_max, avg(voice) AS voice, avg(speech) AS speech, avg(chat) AS chat, avg(motion) AS motion, max(burst) AS burst, max(loud_onset) AS loud_onset, max(startle) AS startle, max(game_audio) AS game_audio,
  max(game_evidence) AS game, coalesce(avg(score) FILTER (t < "pivot"), 0) AS lead, coalesce(avg(score) FILTER (t >= "pivot"), 0) AS settle, avg((score < 0.15 AND game_evidence <= 0)::INT) AS dead_air,
  max((present AND face >= 0.12)::INT) AS in_face, max((voice >= 0.25)::INT) AS in_voice, max((speech >= 0.2)::INT) AS in_speech, max((burst >= 0.12)::INT) AS in_burst, max((chat >= 2.5)::INT) AS in_chat, max((motion >= 0.18)::INT) AS in_motion,
  coalesce(avg(greatest(score, 0)) FILTER (t <= start + 30000), 0) AS hook_energy, coalesce(max(burst) FILTER (t <= start + 30000), 0) AS hook_burst, coalesce(max(chat) FILTER (t <= start + 30000), 0) AS hook_chat, sum(score) AS auc FROM j GROUP BY id),
a AS (SELECT user_id, {", ".join(f"max(({x})::INT) AS on_{c}" for c, x in _ON.items())} FROM f GROUP BY 1), n AS (SELECT w.id, {" + ".join(f"coalesce(in_{c} * on_{c}, 0)" for c in _ON)} AS taking, {" + ".join(f"on_{c}" for c in _ON)} AS active FROM w JOIN a USING (user_id) LEFT JOIN s ON s.id = w.id)
SELECT w.id, taking::INT AS modalities, round(taking / active::DOUBLE, 6) AS agreement, {", ".join(f"round(coalesce(s.{c}, {1 if c == 'dead_air' else 0}) + 1e-9, 5)::DOUBLE AS {c}" for c in _STATS)} FROM w JOIN n ON n.id = w.id LEFT JOIN s ON s.id = w.id""")
def window_statistics(spark, sf_dir):
    frames = events(spark, sf_dir).select(*spark_columns(PART_FRAME)).drop("id").withColumn("game_evidence", F.col("game_evidence").cast("double"))
    x = win.window_statistics(_windows(spark, sf_dir), frames, ["user_id"], 30000.0, 0.15, 100000.0)
    return x.select("id", "modalities", F.round("agreement", 6).alias("agreement"), *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in _STATS])


@P.add(f"""WITH {_FW}, p AS (SELECT * FROM f WHERE present), u AS (SELECT user_id, quantile_cont(face, 0.99) AS p99, quantile_cont(face, 0.5) AS middle FROM p GROUP BY 1),
j AS (SELECT w.id, p.t, p.face, p.t BETWEEN w.start AND w."end" AS inside, greatest(0.4, u.p99) AS bar FROM w JOIN u USING (user_id) JOIN p ON p.user_id = w.user_id AND p.t BETWEEN w.start - 90000 AND w."end" + 90000),
h AS (SELECT id, t, sum(CASE WHEN t - lag <= 50000 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t) AS run FROM (SELECT id, t, lag(t) OVER (PARTITION BY id ORDER BY t) AS lag FROM j WHERE inside AND face >= bar * 0.6)),
r AS (SELECT id, max(n) AS run, sum(n) AS hot FROM (SELECT id, run, count(*) AS n FROM h GROUP BY 1, 2) GROUP BY 1), s AS (SELECT id, max(face) FILTER (inside) AS peak, quantile_cont(face, 0.5) FILTER (NOT inside) AS around FROM j GROUP BY 1)
SELECT w.id, round(coalesce(s.peak, 0), 5)::DOUBLE AS peak, round(coalesce(p99, 0), 5)::DOUBLE AS p99, round(coalesce(around, middle, 0), 5)::DOUBLE AS local, round(greatest(0, coalesce(s.peak, 0) - coalesce(around, middle, 0)), 5)::DOUBLE AS delta
FROM w LEFT JOIN u USING (user_id) LEFT JOIN s ON s.id = w.id LEFT JOIN r ON r.id = w.id""")
def face_context(spark, sf_dir):
    faces = _frames(spark, sf_dir).where("present").select("user_id", "t", "face")
    x = win.face_context(_windows(spark, sf_dir), faces, ["user_id"], 0.4, 0.99, 90000.0, 50000.0, 150000.0)
    return x.select("id", *[F.round(c, 5).alias(c) for c in ("peak", "p99", "local", "delta")])


@P.add(f"""WITH {_FW}, p AS (SELECT * FROM f WHERE present), j AS (SELECT w.id, p.t FROM w JOIN p ON p.user_id = w.user_id AND p.t BETWEEN w.start AND w."end" AND p.face >= 0.4 AND p.face >= (SELECT quantile_cont(face, 0.5) FROM p q WHERE q.user_id = w.user_id)),
h AS (SELECT id, t, sum(CASE WHEN t - lag <= 50000 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t) AS run FROM (SELECT id, t, lag(t) OVER (PARTITION BY id ORDER BY t) AS lag FROM j)), r AS (SELECT id, max(n) AS run, sum(n) AS hot FROM (SELECT id, run, count(*) AS n FROM h GROUP BY 1, 2) GROUP BY 1)
SELECT w.id, coalesce(hot, 0)::BIGINT AS hot, coalesce(r.run, 0)::BIGINT AS run FROM w LEFT JOIN r ON r.id = w.id""")
def face_runs(spark, sf_dir):
    """The same context at the recording's median: frames at the threshold and their longest run."""
    faces = _frames(spark, sf_dir).where("present").select("user_id", "t", "face")
    return win.face_context(_windows(spark, sf_dir), faces, ["user_id"], 0.4, 0.5, 90000.0, 50000.0, 150000.0).select("id", "hot", "run")


def _level(c: str) -> str:
    return f"1 - exp(-greatest(0, least(6, ({c} - {c}_m) / greatest(1e-6, 1.4826 * {c}_d))) / 2)"


@P.add(f"""WITH {_FW}, x AS (SELECT *, CASE WHEN pitch > 0 AND lag(pitch) OVER o > 0 THEN greatest(0, pitch - lag(pitch) OVER o) ELSE 0 END AS rise FROM f WINDOW o AS (PARTITION BY user_id ORDER BY t)),
m AS (SELECT user_id, quantile_cont(rms, 0.5) AS rms_m, quantile_cont(rise, 0.5) AS rise_m, quantile_cont(speech, 0.5) AS speech_m, quantile_cont(burst, 0.5) AS burst_m FROM x GROUP BY 1),
d AS (SELECT user_id, rms_m, rise_m, speech_m, burst_m, quantile_cont(abs(rms - rms_m), 0.5) AS rms_d, quantile_cont(abs(rise - rise_m), 0.5) AS rise_d, quantile_cont(abs(speech - speech_m), 0.5) AS speech_d, quantile_cont(abs(burst - burst_m), 0.5) AS burst_d FROM x JOIN m USING (user_id) GROUP BY ALL)
SELECT id, round(0.45 * ({_level('rms')}) + 0.30 * ({_level('rise')}) + 0.15 * ({_level('speech')}) + 0.10 * ({_level('burst')}), 5)::DOUBLE AS arousal FROM x JOIN d USING (user_id)""")
def arousal_track(spark, sf_dir):
    x = win.voice_arousal(_frames(spark, sf_dir), ["user_id"], "t", "rms", "pitch", "speech", "burst", "arousal")
    return x.select("id", F.round("arousal", 5).alias("arousal"))


@P.add(f"""WITH {_FW}, b AS (SELECT id, rms, quantile_cont(rms, 0.5) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS base FROM f)
SELECT id, round(CASE WHEN base IS NULL OR rms < 0.003 THEN 0 ELSE greatest(0, least(1, (20 * log10(greatest(rms, 1e-8) / greatest(base, 1e-8)) - 6) / 12)) END, 5)::DOUBLE AS onset FROM b""")
def onset_track(spark, sf_dir):
    return win.loud_onsets(_frames(spark, sf_dir), ["user_id"], "t", "rms", "onset").select("id", F.round("onset", 5).alias("onset"))


_TIER = "CASE event_type WHEN 'purchase' THEN 'terminal_win' WHEN 'click' THEN 'elimination' WHEN 'signup' THEN 'knock' WHEN 'error' THEN 'generic_highlight' END"


@P.add(f"""WITH {_FW}, h AS (SELECT user_id, event_id AS h, s AS moment, {_TIER} AS tier FROM {EVENTS_SQL} WHERE event_type <> 'view'),
v AS (SELECT f.id, tier, moment, h, CASE tier WHEN 'terminal_win' THEN 1.0::DOUBLE WHEN 'elimination' THEN 0.7 WHEN 'knock' THEN 0.5 ELSE 0.2 END * (1 - abs(t - moment) / 40000) AS v FROM f JOIN h ON h.user_id = f.user_id AND t BETWEEN moment - 40000 AND moment + 40000),
b AS (SELECT id, max(v) AS v, arg_min(tier, (-v, moment, h)) AS label FROM v WHERE v > 0 GROUP BY 1), n AS (SELECT f.id, count(*) AS n FROM f JOIN h ON h.user_id = f.user_id AND tier <> 'generic_highlight' AND t BETWEEN moment - 50000 AND moment + 50000 GROUP BY 1)
SELECT f.id, round(coalesce(least(1, v * (1 + 0.4 * greatest(0, coalesce(n, 0) - 1))), 0), 5)::DOUBLE AS evidence, b.label, round(1 + 0.4 * greatest(0, coalesce(n, 0) - 1), 3)::DOUBLE AS density FROM f LEFT JOIN b ON b.id = f.id LEFT JOIN n ON n.id = f.id""")
def game_evidence(spark, sf_dir):
    hits = events(spark, sf_dir).where("event_type <> 'view'").select("user_id", F.col("event_id").alias("h"), F.col("s").alias("at"), F.expr(_TIER).alias("tier"))
    x = win.event_evidence(_frames(spark, sf_dir), hits, ["user_id"], 40000.0, 100000.0)
    return x.select("id", F.round("evidence", 5).alias("evidence"), "label", F.round("density", 3).alias("density"))


_LEXICON = [("the", 0.4), ("of the", 0.9), ("and", 0.3), ("de", 0.5), ("de la", 0.8), ("der", 0.6)]
_LEX_SQL = ", ".join(f"('{p}', {w}::DOUBLE)" for p, w in _LEXICON)


@P.add(f"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+') AS w FROM conversations), x AS (SELECT conv_id, turn * 10000 + p AS i, w[p] AS word, turn * 40 + p * 0.4::DOUBLE AS moment, w[p + 1] AS next FROM c, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
o AS (SELECT *, lead(word) OVER (PARTITION BY conv_id ORDER BY i) AS w1 FROM x), l AS (SELECT * FROM (VALUES {_LEX_SQL}) AS v(phrase, weight)),
h AS (SELECT conv_id, moment, weight FROM o JOIN l ON phrase = word OR phrase = word || ' ' || w1), s AS (SELECT conv_id, weight, moment, unnest(range(greatest(0, floor(moment - 1.5))::BIGINT, ceil(moment + 1.5)::BIGINT + 1)) AS t FROM h)
SELECT conv_id, t::BIGINT AS t, round(max(weight * (1 - abs(t - moment) / 1.5)), 5)::DOUBLE AS hype FROM s WHERE weight * (1 - abs(t - moment) / 1.5) > 0 GROUP BY 1, 2""")
def hype_words(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    words = c.select("conv_id", "turn", F.posexplode(win_tokens(F.col("text"))).alias("p", "word")).select("conv_id", (F.col("turn") * 10000 + F.col("p") + 1).alias("i"), "word", (F.col("turn") * 40 + (F.col("p") + 1) * 0.4).cast("double").alias("at"))
    return win.hype_track(words, ["conv_id"], spark.createDataFrame(_LEXICON, "phrase string, weight double")).select("conv_id", "t", F.round("hype", 5).alias("hype"))


def win_tokens(text):
    from streamlens.functions.strings import tokens

    return tokens(text)


@P.add(f"""WITH m AS (SELECT user_id, event_id AS id, s AS t, {details._pick('event_id', details.MESSAGES)} AS text, event_id % 4 AS emotes, event_id % 3 = 0 AS hype FROM {EVENTS_SQL}),
c AS (SELECT *, regexp_matches(text, '{details._INTENT}') AS intent, floor(t / 200000) AS bin, 1 + 0.6 * emotes + 0.8 * hype::INT + 0.5 * contains(text, 'GGGG')::INT AS weight FROM m),
p AS (SELECT *, CASE WHEN intent THEN 'clip that' ELSE lower(trim(text)) END AS phrase FROM c WHERE id % 22 NOT IN (8, 9, 10, 11, 15, 20)), tot AS (SELECT user_id, bin, count(*) AS messages, sum(emotes) AS emotes, count(*) FILTER (intent) AS intents, sum(weight) AS weight FROM c GROUP BY 1, 2),
s AS (SELECT user_id, bin, phrase, count(*) AS n FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, bin ORDER BY n DESC, phrase) AS place FROM s), top AS (SELECT user_id, bin, string_agg(phrase || ':' || n, ',' ORDER BY place) AS repeated, sum(n) AS votes FROM o WHERE place <= 5 GROUP BY 1, 2),
x AS (SELECT tot.*, coalesce(repeated, '') AS repeated, weight + 1.5 * coalesce(votes, 0) + 3 * intents AS strength FROM tot LEFT JOIN top USING (user_id, bin) WHERE repeated IS NOT NULL OR intents > 0 OR messages >= 8 OR emotes >= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(strength, 6) DESC, bin) AS r FROM x) SELECT user_id, (bin * 200000)::DOUBLE AS start, messages::BIGINT AS messages, emotes::BIGINT AS emotes, intents::BIGINT AS intents, repeated, round(strength, 4)::DOUBLE AS strength FROM r WHERE r <= 6""")
def chat_activity(spark, sf_dir):
    from streamlens.functions import strings as st

    e = events(spark, sf_dir).select("user_id", F.col("s").alias("t"), *spark_columns(details.MESSAGE))
    text = F.col("text")
    plain = ~(F.col("id") % 22).isin(8, 9, 10, 11, 15, 20)
    m = e.select("user_id", "t", "emotes", st.is_clip_intent(text).alias("intent"), F.round(st.message_weight(text, F.col("emotes"), F.col("hype")), 6).alias("weight"), F.when(plain, F.regexp_replace(st.shareable_phrase(text), "^be right back$", "be  right\tback")).alias("phrase"))
    x = win.chat_windows(m, ["user_id"], 200000.0, 5, 6)
    return x.select("user_id", F.col("start").cast("double").alias("start"), "messages", F.col("emotes"), "intents", F.array_join("repeated", ",").alias("repeated"), F.round("strength", 4).alias("strength"))


@P.add(f"""WITH {_FW}, j AS (SELECT w.id, w.anchor, f.t, f.rms FROM w JOIN f ON f.user_id = w.user_id AND t BETWEEN w.anchor - 400000 AND w.anchor), m AS (SELECT *, quantile_cont(rms, 0.5) OVER (PARTITION BY id) AS med FROM j),
l AS (SELECT id, t, coalesce(lag(t) OVER (PARTITION BY id ORDER BY t DESC), anchor) - t AS pause FROM m WHERE med > 0 AND rms >= med * 1.2), k AS (SELECT *, max(pause) OVER (PARTITION BY id ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS worst FROM l)
SELECT id, round(min(t) - 2, 3)::DOUBLE AS onset FROM k WHERE worst <= 120000 GROUP BY id""")
def action_onset(spark, sf_dir):
    x = win.action_onsets(_windows(spark, sf_dir).select("user_id", "id", "anchor"), _frames(spark, sf_dir).select("user_id", "t", "rms"), ["user_id"], 400000.0, 120000.0, 1.2, 2.0, 400000.0)
    return x.select("id", F.round("onset", 3).alias("onset"))


@P.add(f"""WITH {_FW}, j AS (SELECT w.id, f.t, f.voice < 0.3 AS quiet FROM w JOIN f ON f.user_id = w.user_id AND t BETWEEN w.anchor + 2000 AND w.anchor + 300000), q AS (SELECT *, lag(quiet) OVER (PARTITION BY id ORDER BY t) AS before FROM j)
SELECT id, round(min(t) + 2, 3)::DOUBLE AS settle FROM q WHERE quiet AND before GROUP BY id""")
def settle_points(spark, sf_dir):
    x = win.settle_ends(_windows(spark, sf_dir), _frames(spark, sf_dir).select("user_id", "t", "voice"), ["user_id"], 2000.0, 300000.0, 0.3, 2.0, 300000.0)
    return x.select("id", F.round("settle", 3).alias("settle"))


@P.add(f"""WITH {_FW}, b AS (SELECT w.id, arg_min(t, (rms, t)) AS moment FROM w JOIN f ON f.user_id = w.user_id AND t BETWEEN w."end" - 50000 AND w."end" + 50000 GROUP BY 1) SELECT w.id, round(coalesce(moment, "end"), 3)::DOUBLE AS snapped FROM w LEFT JOIN b ON b.id = w.id""")
def silence_snaps(spark, sf_dir):
    t = _windows(spark, sf_dir).select("user_id", "id", F.col("end").cast("double").alias("target"))
    return win.quiet_points(t, _frames(spark, sf_dir), ["user_id"], 50000.0, 100000.0).select("id", F.round("snapped", 3).alias("snapped"))


@P.add(f"""WITH {_FW}, j AS (SELECT w.id, f.t, f.rms, f.voice, min(f.rms) OVER (PARTITION BY w.id) * 1.3 + 1e-9 AS low FROM w JOIN f ON f.user_id = w.user_id AND t BETWEEN w.start AND w."end"), s AS (SELECT id, count(*) AS n, min(t) FILTER (rms > low OR voice >= 0.22) AS first, max(t) FILTER (rms > low OR voice >= 0.22) AS last FROM j GROUP BY 1),
x AS (SELECT w.*, n, greatest(0, least(CASE WHEN first - 1 - start >= 3000 THEN first - 1 ELSE start END, peak - 4500)) AS a, greatest(CASE WHEN "end" - last - 1.2 >= 3000 THEN last + 1.2 ELSE "end" END, peak + 2000) AS b FROM w LEFT JOIN s ON s.id = w.id)
SELECT id, round(CASE WHEN coalesce(n, 0) >= 3 AND b - a >= 8000 THEN a ELSE start END, 3)::DOUBLE AS start, round(CASE WHEN coalesce(n, 0) >= 3 AND b - a >= 8000 THEN b ELSE "end" END, 3)::DOUBLE AS "end" FROM x""")
def trimmed_windows(spark, sf_dir):
    x = win.trim_dead_air(_windows(spark, sf_dir), _frames(spark, sf_dir).select("user_id", "t", "rms", "voice"), ["user_id"], 3000.0, 1.3, 0.22, 1.0, 1.2, 4500.0, 2000.0, 8000.0, 100000.0)
    return x.select("id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_WORDS_SQL = """c AS (SELECT conv_id, turn, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM conversations), x AS (SELECT conv_id, w[p] AS word, turn * 1000 + p * 0.4::DOUBLE + CASE WHEN p > 12 THEN 1.5 ELSE 0 END AS start FROM c, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p) WHERE w[p] <> ''),
o AS (SELECT *, start + 0.3 AS "end", lead(start) OVER (PARTITION BY conv_id ORDER BY start) AS next FROM x), z AS (SELECT *, coalesce(regexp_matches(regexp_replace(word, '["''”’)\\]]+$', ''), '[.!?…]$') OR next - "end" > 0.8, FALSE) AS stop FROM o),
i AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY conv_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM z), s AS (SELECT conv_id, min(start) AS start, arg_max("end", start) AS "end" FROM i GROUP BY conv_id, n)"""


def _spoken(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("p", "word"))
    start = (F.col("turn") * 1000 + (F.col("p") + 1) * 0.4 + F.when(F.col("p") >= 12, 1.5).otherwise(0.0)).cast("double")
    return c.select("conv_id", "word", start.alias("start"), (start + 0.3).alias("end")).where("word <> ''")


@P.add(f"""WITH {_WORDS_SQL} SELECT conv_id, round(start, 3)::DOUBLE AS start, round("end", 3)::DOUBLE AS "end" FROM s""")
def sentence_index(spark, sf_dir):
    return win.sentences(_spoken(spark, sf_dir), ["conv_id"]).select("conv_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@P.add(f"""WITH {_WORDS_SQL}, w AS (SELECT conv_id, conv_id * 10 + turn AS id, turn * 1000 + 5.13::DOUBLE AS start, turn * 1000 + 33.7::DOUBLE AS "end", turn * 1000 + 16.0::DOUBLE AS peak FROM conversations),
s1 AS (SELECT w.id, arg_min(s.start, (round(abs(s.start - w.start - 0.25), 9), s.start)) AS v FROM w JOIN s ON s.conv_id = w.conv_id AND s.start BETWEEN w.start + 0.25 - 3.5 AND w.start + 0.25 + 3.5 GROUP BY 1), s2 AS (SELECT w.id, min(s.start) AS v FROM w JOIN s ON s.conv_id = w.conv_id AND s.start BETWEEN w.start AND least(w.start + 7, w.peak - 4.5) GROUP BY 1),
e1 AS (SELECT w.id, min(s."end") AS v FROM w JOIN s ON s.conv_id = w.conv_id AND s."end" BETWEEN w."end" - 0.35 AND w."end" - 0.35 + 3.5 GROUP BY 1), e2 AS (SELECT w.id, min(s."end") AS v FROM w JOIN s ON s.conv_id = w.conv_id AND s."end" BETWEEN w."end" - 1.5 AND w."end" - 1.5 + 3.5 GROUP BY 1),
y AS (SELECT w.*, greatest(0, least(coalesce(coalesce(s1.v, s2.v) - 0.25, start), peak - 4.5)) AS a, greatest(coalesce(coalesce(e1.v, e2.v) + 0.35, "end"), peak + 2) AS b FROM w LEFT JOIN s1 USING (id) LEFT JOIN s2 USING (id) LEFT JOIN e1 USING (id) LEFT JOIN e2 USING (id))
SELECT id, round(CASE WHEN b - a BETWEEN 8 AND 90 THEN a ELSE start END, 3)::DOUBLE AS start, round(CASE WHEN b - a BETWEEN 8 AND 90 THEN b ELSE "end" END, 3)::DOUBLE AS "end" FROM y""")
def sentence_snaps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = c.select("conv_id", (F.col("conv_id") * 10 + F.col("turn")).alias("id"), (F.col("turn") * 1000 + F.lit(5.13).cast("double")).alias("start"), (F.col("turn") * 1000 + F.lit(33.7).cast("double")).alias("end"), (F.col("turn") * 1000 + F.lit(16.0).cast("double")).alias("peak"))
    x = win.refine_to_sentences(w, win.sentences(_spoken(spark, sf_dir), ["conv_id"]), ["conv_id"])
    return x.select("id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@P.add(f"""WITH {_FW}, r AS (SELECT user_id, event_id AS request, s AS moment FROM {EVENTS_SQL} WHERE event_type = 'signup'), p AS (SELECT r.user_id, request, arg_min(t, (-score, t)) AS peak FROM r JOIN f ON f.user_id = r.user_id AND t BETWEEN moment - 150000 AND moment - 2000 GROUP BY 1, 2),
n AS (SELECT request, count(*) AS covering FROM p JOIN w ON w.user_id = p.user_id AND p.peak BETWEEN w.start AND w."end" GROUP BY 1), g AS (SELECT user_id, t, score, sum((score <= 0.6)::INT) OVER (PARTITION BY user_id ORDER BY t) AS run FROM f), s AS (SELECT user_id, run, min(t) AS a, max(t) AS b FROM g WHERE score > 0.6 GROUP BY 1, 2)
SELECT p.request, round(p.peak, 3)::DOUBLE AS peak, coalesce(covering, 0)::BIGINT AS covering, round(coalesce(a, p.peak), 3)::DOUBLE AS start, round(coalesce(b, p.peak), 3)::DOUBLE AS "end" FROM p LEFT JOIN n ON n.request = p.request LEFT JOIN s ON s.user_id = p.user_id AND p.peak BETWEEN a AND b""")
def credited_requests(spark, sf_dir):
    r = events(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("event_id").alias("request"), F.col("s").alias("at"))
    x = win.credited(r, _frames(spark, sf_dir).select("user_id", "t", "score"), _windows(spark, sf_dir).select("user_id", "id", "start", "end"), ["user_id"], 150000.0, 2000.0, 0.6, 150000.0)
    return x.select("request", F.round("peak", 3).alias("peak"), "covering", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@P.add(f"""WITH {_FW}, l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS before FROM f WHERE label = 'error'), g AS (SELECT *, sum(CASE WHEN t - before <= 60000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM l),
a AS (SELECT user_id, min(t) AS first, max(t) AS last, arg_min(t, (-evidence, t)) AS anchor FROM g GROUP BY user_id, run) SELECT user_id, round(first, 3)::DOUBLE AS start, round(last, 3)::DOUBLE AS "end", round(anchor, 3)::DOUBLE AS anchor FROM a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = a.user_id AND a.anchor BETWEEN w.start AND w."end")""")
def win_anchors(spark, sf_dir):
    x = win.label_anchors(_frames(spark, sf_dir).select("user_id", "t", "label", "evidence"), _windows(spark, sf_dir), ["user_id"], "error", 60000.0, 100000.0)
    return x.select("user_id", *[F.round(c, 3).alias(c) for c in ("start", "end", "anchor")])


@P.add(f"""WITH {_FW}, b AS (SELECT user_id, greatest(0.1, 0.5 * quantile_cont(game_audio, 0.995)) AS bar, quantile_cont(motion, 0.5) AS usual FROM f GROUP BY 1), h AS (SELECT f.*, lag(t) OVER (PARTITION BY f.user_id ORDER BY t) AS before FROM f JOIN b USING (user_id) WHERE game_audio >= bar),
g AS (SELECT *, sum(CASE WHEN t - before <= 60000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM h), r AS (SELECT user_id, run, min(t) AS a, max(t) AS z, max(game_audio) AS top FROM g GROUP BY 1, 2 HAVING max(t) - min(t) >= 50000),
m AS (SELECT r.*, (SELECT avg(motion) FROM f WHERE f.user_id = r.user_id AND t BETWEEN a AND z) AS motion FROM r), o AS (SELECT m.*, row_number() OVER (PARTITION BY m.user_id ORDER BY top DESC, a) AS r FROM m JOIN b USING (user_id) WHERE motion >= usual)
SELECT user_id, round(a, 3)::DOUBLE AS start, round(z, 3)::DOUBLE AS "end", round(top, 5)::DOUBLE AS top FROM o WHERE r <= 3""")
def combat_encounters(spark, sf_dir):
    x = win.encounters(_frames(spark, sf_dir).select("user_id", "id", "t", "game_audio", "motion"), ["user_id"], 0.1, 60000.0, 50000.0, 3, ("id",))
    return x.select("user_id", moments.milli(F.col("start")).alias("start"), moments.milli(F.col("end")).alias("end"), F.round("top", 5).alias("top"))


QUERIES, ORACLE = P.queries, P.oracle
