"""Clips and their library: scores, gates, decks, compilations, decisions, state and measures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.operators import candidates, editorial, intervals, library, measures, selection
from streamlens.plans.base import EVENTS_SQL, SECONDS, Plans, events, spark_columns, sql_columns
from streamlens.session import table

P = Plans()


def _share(step: int, of: int) -> str:
    return f"CAST(event_id % {step} AS DOUBLE) / {of}"


#: A candidate per purchase; what signals and judges say is taken from the event's number and value.
CANDIDATE = [
    ("user_id", "user_id"), ("id", "event_id"), ("start", "s"), ("end", "s + 5 + event_id % 70"), ("peak_value", "value / 40"), ("reaction_auc", "value / 4 * (1 + event_id % 5)"), ("event_density", "CAST(1 + event_id % 3 AS DOUBLE)"),
    ("game_evidence", _share(11, 10)), ("dead_air_ratio", _share(9, 10)), ("game_label", "CASE WHEN event_id % 5 = 0 THEN 'elimination' WHEN event_id % 7 = 0 THEN 'terminal_win' END"), ("scene_label", "CASE WHEN event_id % 6 = 1 THEN 'lobby' END"),
    ("floor_padded", "event_id % 17 = 0"), ("crowd_clip", "CAST(event_id % 4 AS INT)"), ("startle", _share(23, 30)), ("visible_crowd", _share(29, 35)), ("modality_count", "CAST(event_id % 5 AS INT)"), ("active_channels", "CAST(1 + event_id % 6 AS INT)"),
    ("signal_agreement", _share(8, 8)), ("anchor", "s + (5 + event_id % 70) * (CAST(event_id % 10 AS DOUBLE) / 10)"), ("peak", "s + (5 + event_id % 70) * (CAST(event_id % 4 AS DOUBLE) / 4)"), ("text_verdict", "CASE event_id % 4 WHEN 0 THEN 'post' WHEN 1 THEN 'skip' WHEN 2 THEN 'maybe' END"),
    ("text_type", "CASE WHEN event_id % 8 < 2 THEN 'filler' ELSE 'story' END"), ("hook", _share(10, 10)), ("payoff", _share(12, 12)), ("self_contained", _share(14, 14)), ("housekeeping", "event_id % 41 = 0"), ("terminal", "event_id % 31 < 3"),
    ("verdict", "CASE event_id % 5 WHEN 1 THEN 'post' WHEN 2 THEN 'maybe' WHEN 3 THEN 'skip' WHEN 4 THEN 'post' END"), ("outcome", "CASE event_id % 9 WHEN 1 THEN 'match_win' WHEN 2 THEN 'elimination' WHEN 3 THEN 'menu_or_shop' WHEN 4 THEN 'death_or_fail' WHEN 5 THEN 'none' END"),
    ("moment_type", "CASE event_id % 3 WHEN 0 THEN 'story' WHEN 1 THEN 'filler' ELSE 'funny' END"), ("onscreen", "CASE event_id % 11 WHEN 1 THEN 'VICTORY royale' WHEN 2 THEN 'You placed #8' WHEN 3 THEN 'Loading map' WHEN 4 THEN 'Chapter 3' WHEN 5 THEN 'Champion #1' END"),
    ("model_verdict", "CASE WHEN event_id % 3 = 0 THEN 'skip' ELSE 'post' END"), ("profile", "CASE WHEN event_id % 2 = 0 THEN 'generic' ELSE 'shooter' END"), ("confidence", _share(13, 12)), ("visual_payoff", _share(15, 14)), ("visual_contained", _share(16, 15)),
    ("context_complete", "event_id % 7 <> 3"), ("routine_only", "event_id % 10 = 7"), ("verbal_payoff", "event_id % 3 <> 1"), ("visual_event", "event_id % 14 = 5"), ("streamer_reaction", "event_id % 6 = 2"), ("speech_unheard", "event_id % 37 = 0"),
    ("voice", _share(19, 40)), ("face_max", _share(21, 30)), ("face_p99", "CASE WHEN event_id % 3 = 0 THEN 0.45 END"), ("face_run", "CAST(event_id % 5 AS INT)"), ("face_delta", _share(17, 40)), ("burst", _share(22, 40)), ("loud_onset", _share(25, 50)),
    ("motion", _share(18, 40)), ("game_audio", _share(24, 60)), ("waiting_share", _share(26, 30)), ("ranker_score", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 20 AS DOUBLE) / 20 END"),
]


def _candidates(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return candidates.complete(e.select(*spark_columns(CANDIDATE)))


_CANDIDATES = f"""
cand AS (SELECT {sql_columns(CANDIDATE)} FROM {EVENTS_SQL} WHERE event_type = 'purchase'),
shaped AS (SELECT *, greatest(1, "end" - start) AS d, game_label IS NOT NULL AS is_event, greatest(0, least(1, (anchor - start) / greatest(1, "end" - start))) AS p,
  coalesce(verdict, '') AS v, coalesce(outcome, '') AS o, coalesce(text_verdict, '') AS tv, coalesce(onscreen, '') AS screen, coalesce(scene_label, '') = 'lobby' AS lobby FROM cand),
scored AS (
  SELECT *, reaction_auc / d AS mean, 1.5 * peak_value + reaction_auc / d + 0.5 * game_evidence + 0.55 * greatest(0, event_density - 1) - 0.35 * greatest(0, dead_air_ratio - 0.35)
    + 0.35 * (CASE WHEN d <= 8 THEN 0 WHEN d < 14 THEN (d - 8) / 6 WHEN d <= 45 THEN 1 WHEN d >= 90 THEN 0.4 ELSE 1 - 0.6 * (d - 45) / 45 END)
    + 0.2 * (CASE WHEN is_event THEN CASE WHEN p BETWEEN 0.35 AND 0.85 THEN 1.0 WHEN p < 0.2 THEN -0.6 WHEN p > 0.92 THEN -0.3 ELSE 0.2 END WHEN p BETWEEN 0.3 AND 0.75 THEN 0.35 ELSE 0 END)
    - CASE WHEN floor_padded THEN 0.4 ELSE 0 END - CASE WHEN lobby THEN 2.5 ELSE 0 END + 0.5 * least(crowd_clip, 3) / 3.0 + 8 * startle + 1.5 * visible_crowd AS score
  FROM shaped),
e1 AS (
  SELECT *, o = 'match_win' AND regexp_matches(screen, 'victor|champion|\\bwinner\\b|#\\s*1\\b|\\b1st\\b', 'i') AND NOT regexp_matches(screen, 'placed|defeat|eliminated|#\\s*([2-9]\\b|\\d{{2,}})|\\b([2-9]|\\d{{2,}})(th|nd|rd)\\b', 'i') AS win,
    startle >= 0.6 AS startled, visible_crowd >= 0.72 AS crowded, confidence >= 0.45 AND verbal_payoff AND context_complete AND NOT routine_only AND visual_contained >= 0.5 AS beat,
    coalesce(face_max >= greatest(0.4, face_p99) AND face_p99 IS NOT NULL AND face_run >= 2 AND face_delta >= 0.2, FALSE) AS spike,
    tv = 'post' AND text_type <> 'filler' AND payoff >= 0.6 AND self_contained >= 0.5 AS whole, tv = 'post' AND text_type <> 'filler' AND hook >= 0.45 AND payoff >= 0.6 AND self_contained >= 0.5 AS rescue,
    peak_value >= 1.25 AND mean >= 0.75 AND signal_agreement >= 0.65 AS hot
  FROM scored),
e2 AS (
  SELECT *, beat AND visual_payoff >= 0.55 AS verbal, beat AND (visual_payoff >= 0.55 OR (moment_type = 'story' AND visual_payoff + 1e-9 >= 0.45)) AS spoken,
    CASE WHEN win THEN startle >= 0.1 OR peak_value >= 1.2 WHEN is_event THEN startle >= 0.15 OR peak_value >= 2.5 ELSE TRUE END AS reacted,
    lobby AND hot AND dead_air_ratio <= 0.3 AND burst >= 0.15 AND greatest(motion, game_audio) >= 0.2 AS lobby_hot, hot AND dead_air_ratio <= 0.45 AS observed
  FROM e1),
e3 AS (SELECT *, (win OR is_event) AND reacted AS landed, ((win OR is_event) AND reacted) OR spoken OR startled OR crowded OR spike AS grounded FROM e2),
e4 AS (
  SELECT *, v IN ('post', 'maybe') AND NOT win AND NOT is_event AND o NOT IN ('match_win', 'elimination', 'death_or_fail') AND NOT visual_event AND NOT regexp_matches(screen, '\\b(rip\\b|game\\s*over|you\\s+died|chapter\\b|ending\\b)', 'i')
      AND NOT startled AND NOT crowded AND voice >= 0.15 AND NOT (spoken AND face_max >= 0.15) AND face_max < 0.22 AND burst < 0.35 AND loud_onset < 0.35 AS chatty,
    v = 'post' AND grounded AND visual_payoff >= 0.7 AND visual_contained >= 0.7 AND context_complete AND NOT routine_only AND tv = 'post' AND payoff >= 0.6 AND self_contained >= 0.7 AS agreed,
    startled OR crowded OR landed OR (NOT routine_only AND context_complete AND visual_payoff >= 0.55 AND visual_contained >= 0.5 AND (verbal_payoff OR streamer_reaction)) AS real
  FROM e3),
evidence AS (
  SELECT *, v <> '' AND (agreed OR CASE WHEN win THEN reacted ELSE FALSE END) AS bypass, v <> '' AND CASE WHEN win THEN reacted ELSE NOT chatty AND verbal END AS anchored, landed OR grounded OR whole OR lobby_hot OR observed AS publishable,
    (v <> '' OR text_verdict IS NOT NULL) AND NOT real AND ((routine_only AND NOT whole) OR (v <> '' AND NOT context_complete AND NOT (verbal_payoff OR visual_event OR streamer_reaction OR o NOT IN ('', 'none')) AND NOT whole)) AS incomplete,
    (lobby OR o = 'menu_or_shop' OR regexp_matches(screen, '\\b(loading|connecting|waiting\\s+for\\s+players|matchmaking|finding\\s+match|searching\\s+for\\s+match|main\\s+menu)\\b', 'i')) AND model_verdict = 'skip' AND tv = 'skip' AND text_type = 'filler' AS waiting,
    waiting_share >= 0.6 AND v NOT IN ('post', 'maybe') AND tv <> 'post' AS waiting_ocr, profile = 'generic' AND game_label IS NULL AND v = 'maybe' AND moment_type = 'filler' AND o IN ('', 'none') AS generic,
    tv = 'post' AND text_type <> 'filler' AND o IN ('', 'none') AND ranker_score IS NOT NULL AND payoff >= 0.7 AND signal_agreement >= 0.75 AND peak_value >= 2.5 AND ranker_score >= 0.7 AND waiting_share < 0.5 AS conflict,
    is_event AND game_evidence >= 0.5 AND dead_air_ratio <= 0.5 AS strong
  FROM e4),
judged AS (
  SELECT *, tv = 'skip' AND (text_type = 'filler' OR v = 'skip') AND NOT (crowded OR (v IN ('post', 'maybe') AND grounded)) AS rejected, v = 'skip' AND NOT speech_unheard AND NOT bypass AND NOT coalesce(conflict, FALSE) AS vskip,
    CASE WHEN modality_count > 0 THEN modality_count ELSE floor(signal_agreement * active_channels + 0.5) END AS m FROM evidence),
failed AS (
  SELECT *, list_filter([
    CASE WHEN housekeeping THEN 'housekeeping' END, CASE WHEN terminal AND NOT real THEN 'terminal_non_content' END, CASE WHEN waiting THEN 'routine_non_gameplay' END, CASE WHEN waiting_ocr AND NOT waiting THEN 'routine_non_gameplay_ocr' END,
    CASE WHEN peak_value < 0.55 THEN 'peak_floor' END, CASE WHEN score < 0.75 THEN 'score_floor' END,
    CASE WHEN NOT (CASE WHEN strong THEN m >= greatest(1, ceil(0.4 * least(active_channels, 4) - 1e-9)) ELSE m >= greatest(least(2, active_channels), ceil(0.5 * least(active_channels, 4) - 1e-9)) END) THEN 'modality_gate' END,
    CASE WHEN dead_air_ratio > 0.65 THEN 'dead_air' END, CASE WHEN lobby AND d > 15 AND NOT lobby_hot THEN 'lobby_length' END, CASE WHEN floor_padded AND NOT strong AND crowd_clip < 2 THEN 'floor_padded' END,
    CASE WHEN incomplete THEN 'incomplete_beat' END, CASE WHEN generic THEN 'visual_filler' END, CASE WHEN is_event AND mean < 0.55 THEN 'routine_event' END,
    CASE WHEN chatty AND (tv = 'skip' OR text_type = 'filler' OR NOT grounded) THEN 'non_event_chatter' END, CASE WHEN text_verdict IS NOT NULL AND v <> '' AND NOT publishable THEN 'unpublishable_beat' END,
    CASE WHEN rejected THEN 'semantic_reject' END, CASE WHEN vskip THEN 'visual_skip' END], lambda x: x IS NOT NULL) AS all_reasons FROM judged),
gated AS (SELECT *, CASE WHEN NOT vskip AND NOT rejected AND (rescue OR crowded OR bypass) THEN list_filter(all_reasons, lambda x: x IN ('housekeeping', 'terminal_non_content', 'incomplete_beat', 'visual_filler', 'non_event_chatter', 'unpublishable_beat')) ELSE all_reasons END AS reasons FROM failed)
"""


def _gated(spark, sf_dir):
    return candidates.with_gates(candidates.with_score(_candidates(spark, sf_dir)))


@P.add(f"""WITH {_CANDIDATES} SELECT id, win, startled, crowded, verbal, spoken, spike, landed, grounded, chatty, agreed, bypass, anchored, lobby_hot, observed, publishable, real, incomplete, waiting, waiting_ocr, generic, coalesce(conflict, FALSE) AS conflict FROM evidence""")
def editorial_evidence(spark, sf_dir):
    names = {
        "win": "visual_win", "startled": "strong_startle", "crowded": "crowd_anchor", "verbal": "verbal_complete", "spoken": "spoken_beat", "spike": "face_spike", "landed": "landed_event", "grounded": "grounded", "chatty": "chat_only",
        "agreed": "consensus", "bypass": "gate_bypass", "anchored": "content_anchor", "lobby_hot": "lobby_reaction", "observed": "observed_reaction", "publishable": "publishable", "real": "real_beat", "incomplete": "incomplete",
        "waiting": "waiting_agreed", "waiting_ocr": "waiting_ocr", "generic": "generic_filler", "conflict": "skip_conflict",
    }
    x = editorial.with_evidence(candidates.with_score(_candidates(spark, sf_dir)))
    return x.select("id", *[F.coalesce(F.col(c), F.lit(False)).alias(n) for n, c in names.items()])


@P.add(f"""WITH {_CANDIDATES}, n AS (SELECT *, v IN ('post', 'maybe') AND NOT chatty AND (o = 'death_or_fail' OR verbal OR (moment_type = 'story' AND NOT routine_only AND context_complete AND confidence >= 0.45 AND visual_payoff + 1e-9 >= 0.45)) AS story FROM evidence)
SELECT id, story, v <> '' AND (agreed OR CASE WHEN win THEN reacted ELSE story END) AS bypass,
  round(CASE WHEN v NOT IN ('', 'skip') THEN greatest(CASE o WHEN 'match_win' THEN CASE WHEN win THEN 1.0::DOUBLE ELSE 0 END WHEN 'elimination' THEN 0.6 WHEN 'death_or_fail' THEN 0.5 ELSE 0 END, CASE WHEN verbal AND NOT chatty THEN visual_payoff * (0.6 + 0.4 * visual_contained) ELSE 0 END) ELSE 0 END, 6) AS interest,
  CASE WHEN v = '' THEN NULL WHEN NOT reacted THEN score >= 6 WHEN v = 'post' THEN grounded OR score >= 6 WHEN v = 'maybe' THEN score >= 6 * CASE WHEN grounded THEN 0.5 ELSE 1.0 END ELSE FALSE END AS keeps,
  rescue OR startled OR crowded OR lobby_hot OR (v <> '' AND (agreed OR CASE WHEN win THEN reacted ELSE story END)) OR burst >= 0.12 OR CASE tv WHEN 'post' THEN payoff >= 0.35 AND self_contained >= 0.5 WHEN 'maybe' THEN hook >= 0.45 AND payoff >= 0.6 AND self_contained >= 0.7 WHEN '' THEN hook >= 0.45 AND signal_agreement >= 0.5 AND dead_air_ratio <= 0.45 ELSE FALSE END AS allowed FROM n""")
def editorial_policies(spark, sf_dir):
    """The narrative policy: story beats, gate bypass, content interest, the floor's three-valued answer and admission among many events."""
    e = editorial.Evidence(narrative=True)
    x = editorial.with_evidence(candidates.with_score(_candidates(spark, sf_dir)), e)
    return x.select("id", F.col("narrative_beat").alias("story"), F.col("gate_bypass").alias("bypass"), F.round(editorial.content_interest(e), 6).alias("interest"), editorial.floor_keep(F.col("signal_score"), F.lit(6.0)).alias("keeps"), editorial.event_rich_allowed().alias("allowed"))


@P.add(f"""WITH {_CANDIDATES}, s AS (SELECT user_id, id, peak, face_delta, face_run, face_max, CASE WHEN peak - lag(peak) OVER (PARTITION BY user_id ORDER BY peak) <= 86400 THEN 0 ELSE 1 END AS fresh FROM evidence WHERE spike),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY peak) AS e FROM s), b AS (SELECT user_id, e, max((face_delta, face_run, face_max)) AS best FROM g GROUP BY 1, 2),
r AS (SELECT user_id, e, row_number() OVER (PARTITION BY user_id ORDER BY best DESC, e) AS r FROM b)
SELECT g.user_id, round(peak, 3) AS peak FROM g JOIN r ON r.user_id = g.user_id AND r.e = g.e AND r <= 3""")
def face_rescues(spark, sf_dir):
    x = editorial.with_evidence(candidates.with_score(_candidates(spark, sf_dir)))
    return editorial.face_spike_events(x, ["user_id"], "peak", 86400.0, 3).select("user_id", F.round("peak", 3).alias("peak"))


@P.add(f"""WITH RECURSIVE {_CANDIDATES}, t AS (SELECT user_id, anchor AS t, row_number() OVER (PARTITION BY user_id ORDER BY anchor) AS i FROM evidence WHERE is_event AND NOT win),
k AS (SELECT user_id, i, t AS kept, t FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, CASE WHEN t.t - k.kept > 50000 THEN t.t ELSE k.kept END, t.t FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1), m AS (SELECT user_id, t FROM k WHERE t = kept),
n AS (SELECT c.user_id, c.id, (SELECT count(*) FROM m WHERE m.user_id = c.user_id AND abs(m.t - c.peak) <= 172800)::BIGINT AS n FROM evidence c) SELECT *, n >= 4 AS rich FROM n""")
def event_rich_spans(spark, sf_dir):
    """How many distinct events (after thinning, without wins that were only seen) stand around each candidate's peak, and whether that makes its surroundings rich in events."""
    c = editorial.with_evidence(candidates.with_score(_candidates(spark, sf_dir)))
    marks = intervals.thin(c.where("is_event AND NOT visual_win").select("user_id", F.col("anchor").alias("t")), ["user_id"], "t", 50000.0)
    spans = c.select("user_id", "id", (F.col("peak") - 172800.0).alias("lo"), (F.col("peak") + 172800.0).alias("hi"))
    n = intervals.points_in(marks, spans, ["user_id"], "t", ("lo", "hi"), 0.0, 345600.0).groupBy("id").agg(F.count("*").alias("n"))
    return c.select("user_id", "id").join(n, "id", "left").select("user_id", "id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= 4).alias("rich"))


@P.add(f"WITH {_CANDIDATES} SELECT id, round(score, 9) AS score, round(mean, 9) AS mean FROM scored")
def signal_scores(spark, sf_dir):
    return candidates.with_score(_candidates(spark, sf_dir)).select("id", F.round("signal_score", 9).alias("score"), F.round("mean_intensity", 9).alias("mean"))


@P.add(f"WITH {_CANDIDATES} SELECT id, array_to_string(reasons, ',') AS reasons FROM gated")
def evidence_gates(spark, sf_dir):
    return _gated(spark, sf_dir).select("id", F.array_join("reasons", ",").alias("reasons"))


@P.add(f"WITH {_CANDIDATES} SELECT id, array_to_string(list_filter(reasons, lambda x: x IN ('housekeeping', 'terminal_non_content', 'routine_non_gameplay', 'routine_non_gameplay_ocr', 'incomplete_beat', 'visual_filler', 'non_event_chatter', 'unpublishable_beat') OR (x = 'visual_skip' AND (tv = 'skip' OR text_type = 'filler'))), ',') AS reasons FROM gated WHERE crowd_clip >= 2")
def crowd_vetoes(spark, sf_dir):
    g = _gated(spark, sf_dir).where("crowd_clip >= 2")
    r = candidates.crowd_reasons(F.col("reasons"), F.coalesce((F.col("text_verdict") == "skip") | (F.col("text_type") == "filler"), F.lit(False)))
    return g.select("id", F.array_join(r, ",").alias("reasons"))


@P.add(f"WITH {_CANDIDATES} SELECT id, array_to_string(list_filter(reasons, lambda x: x IN ('housekeeping', 'terminal_non_content', 'routine_non_gameplay', 'routine_non_gameplay_ocr', 'incomplete_beat', 'visual_filler', 'non_event_chatter', 'unpublishable_beat')), ',') AS reasons FROM gated")
def creator_vetoes(spark, sf_dir):
    """What would still keep out each candidate if its creator had marked it."""
    return _gated(spark, sf_dir).select("id", F.array_join(candidates.creator_reasons(F.col("reasons")), ",").alias("reasons"))


@P.add(f"""WITH {_CANDIDATES}, r AS (SELECT unnest(reasons) AS reason FROM gated) SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason""")
def gate_funnel(spark, sf_dir):
    return _gated(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_DECK = "start - 30000 * (id % 3)"


@P.add(f"""WITH RECURSIVE {_CANDIDATES}, r AS (SELECT user_id, id, {_DECK} AS a, "end" + 20000 * (id % 4) AS b, round(score, 9) AS score, len(reasons) = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS i FROM gated),
k AS (SELECT user_id, i, id, a, b, score, CASE WHEN ok THEN 'selected' ELSE 'gated' END AS disposition, CASE WHEN ok THEN [{{'a': a, 'b': b}}] ELSE [] END AS kept FROM r WHERE i = 1
 UNION ALL SELECT user_id, i, id, a, b, score, disposition,
   CASE disposition WHEN 'selected' THEN list_append(kept, {{'a': a, 'b': b}}) WHEN 'merged' THEN list_transform(kept, lambda x, j: CASE WHEN j = place THEN {{'a': least(x.a, a), 'b': greatest(x.b, b)}} ELSE x END) ELSE kept END AS kept
   FROM (SELECT r.user_id, r.i, r.id, r.a, r.b, r.score, kept, list_position(list_transform(kept, lambda x: greatest(r.a - x.b, x.a - r.b) <= 20000 AND greatest(r.b, x.b) - least(r.a, x.a) <= 150000), TRUE) AS place,
     CASE WHEN NOT ok THEN 'gated' WHEN len(list_filter(kept, lambda x: greatest(0, least(r.b, x.b) - greatest(r.a, x.a)) / least(r.b - r.a, x.b - x.a) > 0.3)) > 0 THEN 'suppressed'
       WHEN len(list_filter(kept, lambda x: greatest(r.a - x.b, x.a - r.b) <= 20000 AND greatest(r.b, x.b) - least(r.a, x.a) <= 150000)) > 0 THEN 'merged' WHEN len(kept) >= 4 THEN 'overflow' ELSE 'selected' END AS disposition
     FROM k JOIN r ON r.user_id = k.user_id AND r.i = k.i + 1))
SELECT user_id, id, disposition, CASE WHEN disposition = 'selected' THEN row_number() OVER (PARTITION BY user_id, disposition = 'selected' ORDER BY i) END::INT AS rank FROM k""")
def deck_selection(spark, sf_dir):
    """Decks of wide windows: gates, suppression, merging of neighbours and a ceiling, over the score."""
    g = _gated(spark, sf_dir).select("user_id", "id", F.expr(_DECK).alias("start"), (F.col("end") + 20000 * (F.col("id") % 4)).alias("end"), F.round("signal_score", 9).alias("score"), (F.size("reasons") == 0).alias("passes"))
    return selection.suppress(g, ["user_id"], near_gap=20000.0, near_span=150000.0, ceiling=4).select("user_id", "id", "disposition", "rank")


@P.add(f"""WITH RECURSIVE {_CANDIDATES}, r AS (SELECT user_id % 20 AS project, id, user_id::VARCHAR AS source, 'clip ' || (id % 200) AS title, start AS a, "end" AS b, row_number() OVER (PARTITION BY user_id % 20 ORDER BY peak_value DESC, id) AS i FROM cand),
k AS (SELECT project, i, TRUE AS ok, id, source, a, [{{'s': source, 't': title, 'a': a, 'b': b}}] AS kept, b - a AS used FROM r WHERE i = 1
 UNION ALL SELECT project, i, ok, id, source, a, CASE WHEN ok THEN list_append(kept, {{'s': source, 't': title, 'a': a, 'b': b}}) ELSE kept END, CASE WHEN ok THEN used + (b - a) ELSE used END
 FROM (SELECT r.*, kept, used, len(list_filter(kept, lambda x: x.s = r.source)) < 3 AND len(list_filter(kept, lambda x: x.t = r.title)) = 0 AND used + (r.b - r.a) <= 600 AND len(list_filter(kept, lambda x: x.s = r.source AND greatest(0, least(r.b, x.b) - greatest(r.a, x.a)) / least(r.b - r.a, x.b - x.a) >= 0.55)) = 0 AS ok
   FROM k JOIN r ON r.project = k.project AND r.i = k.i + 1))
SELECT project, id, (row_number() OVER (PARTITION BY project ORDER BY source, a, id) - 1)::INT AS position FROM k WHERE ok""")
def diverse_compilation(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    rows = c.select(F.pmod("user_id", F.lit(20)).alias("project"), "id", F.col("user_id").cast("string").alias("source"), F.concat(F.lit("clip "), (F.col("id") % 200).cast("string")).alias("title"), "start", "end", F.lit(None).cast("int").alias("rank"), F.col("peak_value").alias("score"))
    return selection.diverse_top(rows, ["project"], 3, 0.55, 600.0)


@P.add(f"""WITH m AS (SELECT user_id, {SECONDS} AS t, CASE event_type WHEN 'purchase' THEN 'elimination' WHEN 'signup' THEN 'win' WHEN 'error' THEN 'lobby' ELSE 'event' END AS kind FROM events), l AS (SELECT *, sum((kind = 'lobby')::INT) OVER (PARTITION BY user_id ORDER BY t, kind) AS lobbies FROM m),
b AS (SELECT *, CASE WHEN lag(kind) OVER o = 'win' OR t - lag(t) OVER o > 86400 OR lobbies <> lag(lobbies) OVER o OR lag(t) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM l WHERE kind <> 'lobby' WINDOW o AS (PARTITION BY user_id ORDER BY t, kind)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, kind) AS g FROM b),
n AS (SELECT user_id, g, count(*) AS n, bool_or(kind = 'win') AS closed FROM g GROUP BY 1, 2), j AS (SELECT user_id, g, sum(CASE WHEN n < 2 AND NOT coalesce(before, TRUE) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY g) AS m FROM (SELECT *, lag(closed) OVER (PARTITION BY user_id ORDER BY g) AS before FROM n)),
x AS (SELECT g.user_id, j.m, min(t) AS a, max(t) AS b, count(*) AS n, count(*) FILTER (kind = 'elimination') AS kills, bool_or(kind = 'win') AS won FROM g JOIN j ON j.user_id = g.user_id AND j.g = g.g GROUP BY 1, 2)
SELECT user_id, m::INT AS match, round(a, 3)::DOUBLE AS start, round(b, 3)::DOUBLE AS "end", n::INT AS n, kills::INT AS eliminations, CASE WHEN won THEN 'win' END AS outcome, CASE WHEN won AND kills = 0 THEN 'low' WHEN won AND kills >= 3 THEN CASE WHEN b - a > 1500 THEN 'medium' ELSE 'high' END WHEN won OR kills >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM x""")
def match_segments(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "elimination").when(F.col("event_type") == "signup", "win").when(F.col("event_type") == "error", "lobby").otherwise("event")
    m = events(spark, sf_dir).select("user_id", F.col("s").alias("t"), kind.alias("kind"))
    return selection.sessionise(m, ["user_id"], 86400.0).select("user_id", "match", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n", "eliminations", "outcome", "confidence")


@P.add(f"""WITH RECURSIVE e AS (SELECT user_id, {SECONDS} AS t, value FROM events), o AS (SELECT user_id, t AS a, t + 30000 AS b, max(t + 30000) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a) AS run FROM o), s AS (SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, run),
k AS (SELECT user_id, a, b, 0 AS depth, b - a <= 90000 AS done FROM s UNION ALL
 SELECT user_id, CASE side WHEN 0 THEN a ELSE cut END, CASE side WHEN 0 THEN coalesce(cut, b) ELSE b END, depth + 1, cut IS NULL OR CASE side WHEN 0 THEN cut - a ELSE b - cut END <= 90000
 FROM (SELECT k.user_id, k.a, k.b, depth, arg_min(e.t, (e.value, e.t)) AS cut FROM k LEFT JOIN e ON e.user_id = k.user_id AND e.t > k.a AND e.t < k.b WHERE NOT done GROUP BY ALL) x, (SELECT unnest([0, 1]) AS side) y WHERE cut IS NOT NULL OR side = 0)
SELECT user_id, round(a, 3)::DOUBLE AS start, round(b, 3)::DOUBLE AS "end" FROM k WHERE done""")
def split_arcs(spark, sf_dir):
    e = events(spark, sf_dir)
    arcs = intervals.merge_spans(e.select("user_id", F.col("s").alias("start"), (F.col("s") + 30000).alias("end")), ["user_id"], "start", "end", 0.0)
    return selection.split_long(arcs, ["user_id"], e.select("user_id", F.col("s").alias("t"), "value"), 90000.0).select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


# decisions and state


@P.add("""WITH d AS (SELECT event_id % 500 AS clip, event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS label, event_type FROM events WHERE event_type <> 'signup')
SELECT clip, arg_max(label, id)::INT AS label, arg_max(event_type, id) AS event, max(id) AS id FROM d GROUP BY clip""")
def latest_decisions(spark, sf_dir):
    d = events(spark, sf_dir).where("event_type <> 'signup'").select((F.col("event_id") % 500).alias("clip"), F.col("event_id").alias("id"), F.col("event_type").isin("click", "view").cast("int").alias("label"), F.col("event_type").alias("event"))
    return library.latest(d, ["clip"], "id").select("clip", "label", "event", "id")


@P.add("""WITH v AS (SELECT l_orderkey % 800 AS k, l_orderkey * 10 + l_linenumber AS v, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), c AS (SELECT k, arg_max(q, v) AS q FROM v GROUP BY 1)
SELECT p_partkey AS k, coalesce(c.q, p.p_size::DOUBLE) AS q FROM part p LEFT JOIN c ON c.k = p_partkey UNION ALL SELECT c.k, c.q FROM c WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = c.k)""")
def upserted_state(spark, sf_dir):
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("q"))
    l = table(spark, sf_dir, "lineitem")
    changes = l.groupBy((F.col("l_orderkey") % 800).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("v")).agg(F.max("l_quantity").alias("q"))
    return library.upsert(base.withColumn("v", F.lit(0).cast("long")), changes, ["k"], "v").select("k", "q")


@P.add("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P')::INT, o_totalprice DESC, o_orderkey)::INT AS rank FROM orders""")
def presentation_ranks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return library.presentation_rank(o, ["o_custkey"], F.col("o_orderstatus") == "P", F.col("o_totalprice"), "o_orderkey").select("o_orderkey", "rank")


@P.add("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50)::BIGINT END AS n FROM orders)
SELECT o_orderkey, coalesce(n, coalesce(max(n) OVER (PARTITION BY o_custkey), 0) + row_number() OVER (PARTITION BY o_custkey, n IS NULL ORDER BY o_orderdate, o_orderkey)) AS n FROM o""")
def numbered_clips(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("n", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 50))
    return library.number_missing(o, ["o_custkey"], "n", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "n")


@P.add("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20""")
def newest_rows(spark, sf_dir):
    return library.keep_newest(events(spark, sf_dir), ["user_id"], "event_id", 20).select("event_id")


@P.add("""WITH o AS (SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
SELECT o_orderkey FROM o WHERE total - before > 1500000""")
def evicted_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return library.evict(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", 1500000.0).select("o_orderkey")


@P.add("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE coalesce(CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 1 END, 0) >= 2)""")
def stale_sources(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "F", 1).alias("v"))
    return library.stale(table(spark, sf_dir, "customer"), done, "c_custkey", "v", 2).select("c_custkey")


@P.add("""SELECT l.doc_id FROM (SELECT doc_id FROM documents) l WHERE l.doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def dangling_links(spark, sf_dir):
    return library.dangling(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "embeddings"), "vec_id")


@P.add("""WITH x AS (SELECT NULLIF(event_id % 50, 0) AS oid, NULLIF(user_id % 30, 0) AS asset, value / 100 AS c, event_id FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN asset IS NULL THEN 'missing_asset' END, CASE WHEN c IS NULL OR c < 0 OR c > 1 THEN 'confidence_range' END], lambda v: v IS NOT NULL), ',') AS broken FROM x WHERE asset IS NULL OR c < 0 OR c > 1""")
def integrity_report(spark, sf_dir):
    x = events(spark, sf_dir).select("event_id", F.nullif(F.col("user_id") % 30, F.lit(0)).alias("asset"), (F.col("value") / 100).alias("c"))
    return library.integrity(x, "event_id", "asset", "c").select("event_id", F.array_join("broken", ",").alias("broken"))


# measures


@P.add("""WITH f AS (SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN r END) AS rank, max(ms) AS ms FROM (SELECT o_custkey, o_orderpriority, round(o_totalprice)::BIGINT AS ms, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY 1)
SELECT count(*)::BIGINT AS cases, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS top1, round(avg(coalesce((rank <= 3)::INT, 0)), 6) AS top3, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS top5, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(ms), 3) AS mean_latency,
list_sort(list(ms))[ceil(0.95 * count(*))::INT]::BIGINT AS p95_latency FROM f""")
def search_quality(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).withColumn("ms", F.round("o_totalprice").cast("long"))
    first = o.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("r"))).alias("rank"), F.max("ms").alias("ms"))
    m = measures.ranking_metrics(first, "rank", "ms")
    return m.select("cases", *[F.round(c, 6).alias(c) for c in ("top1", "top3", "top5", "mrr")], F.round("mean_latency", 3).alias("mean_latency"), "p95_latency")


@P.add("""SELECT lang, count(*) FILTER (n_chars >= 1000 AND quality = 1)::BIGINT AS tp, count(*) FILTER (n_chars >= 1000 AND quality <> 1)::BIGINT AS fp, count(*) FILTER (n_chars < 1000 AND quality = 1)::BIGINT AS fn, count(*) FILTER (n_chars < 1000 AND quality <> 1)::BIGINT AS tn
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def confusion_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return measures.confusion(d, ["lang"], F.col("quality") == 1, F.col("n_chars") >= 1000)


@P.add("""WITH d AS (SELECT n_chars AS score, quality FROM documents JOIN labels USING (doc_id)), p AS (SELECT count(*) FILTER (quality = 1) AS positives FROM d),
t AS (SELECT s.score AS threshold, (SELECT count(*) FROM d WHERE d.score < s.score AND quality = 1) AS lost, (SELECT count(*) FROM d WHERE d.score < s.score AND quality <> 1) AS removed FROM (SELECT DISTINCT score FROM d) s)
SELECT threshold, removed::BIGINT AS removed, lost::BIGINT AS lost FROM t, p WHERE lost <= 0.05 * positives ORDER BY removed DESC, threshold DESC LIMIT 1""")
def rejection_sweep(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return measures.threshold_sweep(d, "n_chars", F.col("quality") == 1, 0.05)


@P.add("""WITH r AS (SELECT user_id, event_type AS phase, sum(value) AS seconds FROM events GROUP BY 1, 2), l AS (SELECT user_id, count(*) AS length FROM events GROUP BY 1), last AS (SELECT user_id FROM l ORDER BY user_id DESC LIMIT 8),
x AS (SELECT phase, seconds / length AS v FROM r JOIN l USING (user_id) WHERE user_id IN (SELECT user_id FROM last))
SELECT phase, round(list_sort(list(v))[count(*) // 2 + 1], 6) AS rate, count(*)::BIGINT AS n FROM x GROUP BY phase""")
def stage_rates(spark, sf_dir):
    r = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("value").alias("seconds"), F.count("*").alias("k"))
    runs = r.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "seconds"))).alias("phases"), F.sum("k").alias("length"))
    return measures.stage_rates(runs.withColumn("finished", F.col("user_id")), "user_id", "finished", "phases", F.col("length")).select("phase", F.round("rate", 6).alias("rate"), "n")


@P.add("""SELECT user_id, ((count(*) * count(*) - sum(n2)) // 2)::BIGINT AS pairs FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS n2 FROM events) GROUP BY user_id""")
def training_pairs(spark, sf_dir):
    return measures.unequal_pairs(events(spark, sf_dir), ["user_id"], "event_type")


@P.add("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'purchase') > 0 AS hit FROM events GROUP BY 1, 2), g AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY user_id ORDER BY day) AS g FROM d),
r AS (SELECT user_id, g, count(*) FILTER (hit) AS n, max(day) AS last FROM g GROUP BY 1, 2) SELECT user_id, max(n)::BIGINT AS longest, arg_max(n, last)::BIGINT AS current FROM r GROUP BY user_id""")
def keeper_streaks(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "purchase") > 0).alias("hit"))
    return measures.streaks(d, ["user_id"], "day", F.col("hit"))


@P.add("""WITH x AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'error') AS b, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, round(a / sqrt(n + 1), 6) AS interest, round(a / (n + 5)::DOUBLE, 6) AS rate, round((a - b) / (n + 4)::DOUBLE, 6) AS net FROM x""")
def learning_signals(spark, sf_dir):
    x = measures.smoothed_signal(events(spark, sf_dir), ["user_id"], F.col("event_type") == "click", F.col("event_type") == "error")
    return x.select("user_id", *[F.round(c, 6).alias(c) for c in ("interest", "rate", "net")])


@P.add(f"""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY {SECONDS}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, quantile_cont(value, 0.8) OVER (PARTITION BY user_id) AS q FROM events)
SELECT user_id, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS spread, round(max(value), 4) AS top, round(avg(value) FILTER (i * 3 // n = 0), 5) AS first, round(avg(value) FILTER (i * 3 // n = 1), 5) AS middle, round(avg(value) FILTER (i * 3 // n = 2), 5) AS last, round(avg(value) FILTER (i * 3 // n = 2) / greatest(avg(value) FILTER (i * 3 // n = 0), 1e-6), 4) AS ratio, round(regr_slope(value, i), 6) AS slope, round(arg_max(i, (value, -i)) / (max(n) - 1)::DOUBLE, 5) AS peak_place, round(avg((value > q)::INT), 5) AS share_high FROM e GROUP BY user_id""")
def trajectory_stats(spark, sf_dir):
    x = measures.trajectory(events(spark, sf_dir), ["user_id"], "s", "value")
    return x.select("user_id", *[F.round(c, 5).alias(c) for c in ("mean", "spread", "first", "middle", "last", "peak_place", "share_high")], F.round("ratio", 4).alias("ratio"), F.round("top", 4).alias("top"), F.round("slope", 6).alias("slope"))


@P.add("""SELECT user_id, count(*)::BIGINT AS total, count(*) FILTER (event_type = 'click')::BIGINT AS click, count(*) FILTER (event_type = 'error')::BIGINT AS error, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchase, count(*) FILTER (event_type = 'signup')::BIGINT AS signup, count(*) FILTER (event_type = 'view')::BIGINT AS view FROM events GROUP BY 1""")
def state_pivot(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    p = events(spark, sf_dir).groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)
    return p.withColumn("total", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))


@P.add("""SELECT user_id, sum((json_extract(props, '$.k'))::BIGINT)::BIGINT AS k_sum, count(*) FILTER ((json_extract(props, '$.k'))::INT >= 50)::BIGINT AS high, round(count(*) FILTER ((json_extract(props, '$.k'))::INT >= 50) / count(*)::DOUBLE, 6) AS share FROM events GROUP BY 1""")
def evidence_counters(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return events(spark, sf_dir).withColumn("k", k).groupBy("user_id").agg(F.sum("k").alias("k_sum"), F.count_if(F.col("k") >= 50).alias("high"), F.round(F.try_divide(F.count_if(F.col("k") >= 50), F.count("*")), 6).alias("share"))


@P.add("""WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1), w AS (SELECT isodow(day)::INT AS weekday, sum(n + 1) AS v FROM d GROUP BY 1), b AS (SELECT weekday FROM w ORDER BY v DESC, weekday LIMIT 1)
SELECT strftime(day, '%Y-%m-%d') AS day, sum(n + 1)::BIGINT AS value, isodow(day)::INT AS weekday, isodow(day) = (SELECT weekday FROM b) AS busiest FROM d GROUP BY day""")
def calendar_value(spark, sf_dir):
    """Value of each day, and whether it falls on the weekday of most value (the first of equals)."""
    d = events(spark, sf_dir).groupBy(F.to_date("ts").alias("d")).agg((F.count_if(F.col("event_type") == "purchase") + 1).alias("value")).withColumn("weekday", F.weekday("d") + 1)
    best = d.groupBy("weekday").agg(F.sum("value").alias("v")).agg(F.max_by("weekday", F.struct("v", -F.col("weekday"))).alias("best"))
    return d.join(F.broadcast(best), F.lit(True)).select(F.date_format("d", "yyyy-MM-dd").alias("day"), "value", "weekday", (F.col("weekday") == F.col("best")).alias("busiest"))


@P.add("""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS sources, min(o_orderkey)::BIGINT AS first_id, max(o_orderkey)::BIGINT AS last_id, sum(o_orderkey % 1009)::BIGINT AS mark FROM orders GROUP BY 1""")
def month_groups(spark, sf_dir):
    """A row per month: how many, from how many sources, and a mark of the ids."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return o.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("sources"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"), F.sum(F.col("o_orderkey") % 1009).alias("mark"))


@P.add("""SELECT n_name, o_orderstatus, count(DISTINCT o_orderkey)::BIGINT AS orders, count(DISTINCT p_brand)::BIGINT AS brands, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def candidate_pool(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    j = j.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy("n_name", "o_orderstatus").agg(F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("p_brand").alias("brands"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@P.add("""WITH c AS (SELECT user_id AS k, max(event_id) AS latest, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), v AS (SELECT user_id AS k, count(DISTINCT event_id % 7) AS projects FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT u.user_id, coalesce(c.latest, -1)::BIGINT AS latest, coalesce(v.projects, 0)::BIGINT AS projects FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c ON c.k = user_id LEFT JOIN v ON v.k = user_id""")
def preaggregated_joins(spark, sf_dir):
    """Two children of one parent are aggregated before they are joined, so neither multiplies the other."""
    e = events(spark, sf_dir)
    c = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("latest"))
    v = e.where("event_type = 'view'").groupBy("user_id").agg(F.count_distinct(F.col("event_id") % 7).alias("projects"))
    return e.select("user_id").distinct().join(c, "user_id", "left").join(v, "user_id", "left").select("user_id", F.coalesce("latest", F.lit(-1)).alias("latest"), F.coalesce("projects", F.lit(0)).alias("projects"))


QUERIES, ORACLE = P.queries, P.oracle
