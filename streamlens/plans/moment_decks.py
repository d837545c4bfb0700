"""Moment groups, their representatives, rescues into empty stretches and whole decks, over the candidates with spans of hours."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.operators import candidates, decks, editorial, features
from streamlens.plans.base import Plans
from streamlens.plans.clips import _CANDIDATES, _candidates
from streamlens.shared import written

P = Plans()
MOMENT = decks.Moment(near_gap=20000.0, near_span=150000.0, span=300000.0, anchors=60000.0, token_gap=200000.0)
DECK = decks.Deck(ceiling=5, rich_window=400000.0, event_gap=50000.0, recovery=3, band=3, gap_times=1.5)
_END = "start + (\"end\" - start) * 600"
_WORDS = [f"'{c}' || (id % {n})" for c, n in (("a", 3), ("b", 2), ("c", 4), ("d", 5))]
_ANCHOR = "CASE WHEN id % 3 <> 0 THEN anchor END"
_ASKED, _CREATOR, _AGREED = "crowd_clip >= 3 OR id % 17 = 3", "id % 17 = 3", "consensus OR id % 4 = 1"


#: What groups, representatives and rescues read; rows of a hundred columns and more would leave Spark's compiled code and be written whole at each step.
_ROW = ["user_id", "id", "start", "end", "peak", "anchor", "label", "tokens", "score", "creator", "protected", "crowd_clip", "payoff", "visual_payoff", "consensus", "terminal", "anchored_win", "is_event", *decks.EVIDENCE[1:]]
#: What a whole deck's gates, floors and face rescues read besides.
_GATED = ["reasons", "text_rescue", "lobby_reaction", "content_anchor", "publishable", "profile", "verdict", "grounded", "reaction_landed", "face_delta", "face_run", "face_max"]


def _named(x, *more: str):
    """Scored rows with evidence as the deck's steps name them: _ROW and more of their columns."""
    at = F.col("start")
    named = x.withColumns({
        "score": F.round("signal_score", 9), "end": at + (F.col("end") - at) * 600, "anchor": F.expr(_ANCHOR), "label": F.col("game_label"), "tokens": F.array(*[F.expr(f"CAST({w} AS STRING)") for w in _WORDS]), "creator": F.expr(_CREATOR), "protected": F.expr(_ASKED),
        "consensus": F.expr(_AGREED), "terminal": F.coalesce(F.col("game_label") == "terminal_win", F.lit(False)), "anchored_win": F.col("visual_win") & F.col("content_anchor"),
    })
    return named.select(*_ROW, *more)


def _rows(spark, sf_dir):
    """Candidates with evidence, in the order of their score."""
    x = _named(editorial.with_evidence(candidates.with_score(_candidates(spark, sf_dir))))
    return x.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "id")).cast("long"))


_BASE = f"""{_CANDIDATES}, base AS (SELECT user_id, id, start, {_END} AS "end", round(score, 9) AS score, {_ANCHOR} AS anchor, game_label AS label, [{", ".join(_WORDS)}] AS tokens, {_CREATOR} AS creator, {_ASKED} AS protected, agreed OR id % 4 = 1 AS consensus, coalesce(game_label = 'terminal_win', FALSE) AS terminal_event,
  win, landed, spike, startled, crowded, spoken, crowd_clip, payoff, visual_payoff, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS place FROM evidence)"""
_TOGETHER, _APART = 'greatest(x.b, n."end") - least(x.a, n.start)', 'greatest(0, x.a - n."end", n.start - x.b)'
_SHARE = 'greatest(0, least(x.b, n."end") - greatest(x.a, n.start)) / least(x.b - x.a, n."end" - n.start)'
_ALIKE = f"({_APART}) <= 200000 AND ({_TOGETHER}) <= 300000 AND len(list_intersect(x.tok, n.tokens)) >= 3 AND len(list_intersect(x.tok, n.tokens)) >= 0.45 * len(list_distinct(list_concat(x.tok, n.tokens)))"
_SAME = f"(({_TOGETHER}) <= 300000 AND ((({_TOGETHER}) <= 150000 + 1e-9 AND (({_SHARE}) > 0.3 OR ({_APART}) <= 20000)) OR coalesce((x.label IS NULL OR n.label IS NULL OR x.label = n.label) AND abs(x.anchor - n.anchor) <= 60000, FALSE) OR ({_ALIKE})))"
_ITEM = "{{'a': {p}.start, 'b': {p}.\"end\", 'anchor': {p}.anchor, 'label': {p}.label, 'tok': {p}.tokens, 'g': {g}}}"
_GROUPS = f"""{_BASE},
k AS (SELECT user_id, place, id, place AS grp, 'seed' AS source, [{_ITEM.format(p="base", g="base.place")}] AS kept FROM base WHERE place = 1
 UNION ALL SELECT n.user_id, n.place, n.id, n.grp, CASE WHEN n.first IS NULL THEN 'seed' WHEN n.words > 0 THEN 'tokens' ELSE 'temporal' END, list_append(n.kept, {_ITEM.format(p="n", g="n.grp")})
 FROM (SELECT n.*, coalesce(n.first, n.place) AS grp, len(list_filter(n.rel, lambda x: x.g = n.first AND {_ALIKE})) AS words FROM (SELECT n.*, list_min(list_transform(n.rel, lambda x: x.g)) AS first
   FROM (SELECT n.*, k.kept, list_filter(k.kept, lambda x: {_SAME}) AS rel FROM k JOIN base n ON n.user_id = k.user_id AND n.place = k.place + 1) n) n) n)"""


@P.add(f"""WITH RECURSIVE {_GROUPS} SELECT user_id, id, place, grp AS "group", source FROM k""")
def moment_groups(spark, sf_dir):
    """In order of score every candidate joins the first group that holds one of the same moment."""
    return decks.moment_groups(written(_rows(spark, sf_dir), "rows"), ["user_id"], MOMENT).select("user_id", "id", "place", "group", "source")


@P.add(f"""WITH RECURSIVE {_GROUPS}, g AS (SELECT b.*, grp, source, count(*) OVER w AS n, min(b.place) OVER w AS first, max(crowd_clip) OVER w AS asked,
  first_value(b.place) OVER (PARTITION BY b.user_id, grp ORDER BY creator DESC, win DESC, landed DESC, spike DESC, startled DESC, crowded DESC, spoken DESC, score DESC, start, b.place) AS best FROM base b JOIN k USING (user_id, id) WINDOW w AS (PARTITION BY b.user_id, grp))
SELECT user_id, id, grp AS "group", CASE WHEN place = best THEN first WHEN place = first THEN best ELSE place END AS place, CASE WHEN best = first OR place NOT IN (best, first) THEN source WHEN place = best THEN source || ':representative' ELSE source || ':alternate' END AS source,
  CASE WHEN asked > 0 AND n > 1 AND place = best THEN TRUE WHEN asked > 0 AND n > 1 AND crowd_clip > 0 AND NOT creator THEN FALSE ELSE protected END AS protected, CASE WHEN n > 1 AND place = best THEN asked ELSE crowd_clip END::INT AS crowd_clip FROM g""")
def moment_representatives(spark, sf_dir):
    """The window of most evidence takes its group's first place, and the viewers' request with it."""
    g = decks.moment_groups(written(_rows(spark, sf_dir), "rows"), ["user_id"], MOMENT)
    return decks.representatives(g, ["user_id"]).select("user_id", "id", "group", "place", "source", "protected", "crowd_clip")


def _swap(n: int, before: str) -> str:
    """One rescue in SQL: CTEs from the dispositions of before to r<n>."""
    return f"""
d{n} AS (SELECT *, count(*) OVER u AS n, (arg_max(mid, (start, place)) OVER u - arg_min(mid, (start, place)) OVER u) / greatest(1, count(*) OVER u - 1) AS spacing, lead(start) OVER (PARTITION BY user_id ORDER BY start, place) AS next,
  least(mid - lag(mid) OVER (PARTITION BY user_id ORDER BY mid, place), lead(mid) OVER (PARTITION BY user_id ORDER BY mid, place) - mid) AS lone FROM {before} WHERE starts_with(disposition, 'selected') WINDOW u AS (PARTITION BY user_id)),
f{n} AS (SELECT user_id, "end" AS a, next AS b, next - "end" AS room, start AS o, place AS p FROM d{n} WHERE n >= 5 AND spacing > 0 AND next > "end" AND next - "end" >= 1.5 * spacing),
c{n} AS (SELECT user_id, first(id ORDER BY room DESC, o, p, coalesce(payoff, 0) DESC, coalesce(visual_payoff, 0) DESC, least(mid - a, b - mid) DESC, score DESC, place) AS comes FROM f{n} JOIN {before} x USING (user_id) WHERE NOT starts_with(disposition, 'selected') AND consensus AND mid BETWEEN a + 0.2::DOUBLE * room AND b - 0.2::DOUBLE * room GROUP BY user_id),
g{n} AS (SELECT user_id, first(id ORDER BY consensus, score, lone, place) AS goes FROM d{n} WHERE n >= 5 AND spacing > 0 AND NOT protected AND NOT win AND NOT terminal_event AND lone <= spacing GROUP BY user_id), s{n} AS (SELECT * FROM c{n} JOIN g{n} USING (user_id)),
r{n} AS (SELECT x.* REPLACE (CASE WHEN id = comes THEN 'selected_temporal_rescue' WHEN id = goes THEN 'temporal_blackout_rebalanced' ELSE disposition END AS disposition) FROM {before} x LEFT JOIN s{n} USING (user_id))"""


@P.add(f"""WITH RECURSIVE {_BASE}, r0 AS (SELECT *, (start + "end") / 2 AS mid, CASE WHEN place <= 5 THEN 'selected_primary' ELSE 'clip_ceiling' END AS disposition FROM base), {_swap(1, "r0")}, {_swap(2, "r1")} SELECT user_id, id, disposition FROM r2""")
def rebalanced_deck(spark, sf_dir):
    """Full decks give up their weakest crowded clips for agreed ones in long empty stretches."""
    x = _rows(spark, sf_dir).withColumn("disposition", F.when(F.col("place") <= 5, "selected_primary").otherwise("clip_ceiling"))
    return decks.rebalanced(x, ["user_id"], DECK, 100000.0).select("user_id", "id", "disposition")


def deck_rows(spark, sf_dir):
    """What the whole deck reads: gates, exemptions from floors, rescues by faces, admission among many events. Rows without a recording or a number take no part."""
    x = candidates.with_gates(candidates.with_score(_candidates(spark, sf_dir))).where("user_id IS NOT NULL AND id IS NOT NULL")
    x = _named(x.withColumn("ordinary", editorial.event_rich_allowed()), "ordinary", *_GATED)
    exempt = F.col("text_rescue") | F.col("strong_startle") | F.col("crowd_anchor") | F.col("lobby_reaction") | F.col("content_anchor")
    x = written(x.withColumns({"passes": F.size("reasons") == 0, "exempt": exempt}).drop("reasons", "text_rescue", "lobby_reaction", "content_anchor"), "gated")
    rescue = editorial.face_spike_events(x, ["user_id"], "peak", 86400.0, 3).distinct().withColumn("face_rescue", F.lit(True))
    x = x.join(rescue, ["user_id", "peak"], "left").withColumn("face_rescue", F.coalesce("face_rescue", F.lit(False)) & F.col("face_spike"))
    return x.drop("face_delta", "face_run", "face_max")


_ORDINAL = "CASE game_label WHEN 'elimination' THEN 0.8 WHEN 'terminal_win' THEN 1.0 ELSE 0 END"
_SEEN = "v <> ''"
_VECTOR = [
    "0", "voice", "0", "game_evidence", "peak_value", "reaction_auc / d", "reaction_auc", "d", _ORDINAL, "coalesce((game_label = 'terminal_win')::INT, 0)", "greatest(0, least(1, (peak - start) / d))", "greatest(0, least(1, (anchor - start) / d))", "0", "0", "dead_air_ratio", "signal_agreement",
    "coalesce(hook, 0)", "coalesce(self_contained, 0)", "coalesce(payoff, 0)", "0", "0", "0", "active_channels", "0", "0", f"CASE WHEN {_SEEN} THEN win::INT ELSE 0 END", f"CASE WHEN {_SEEN} THEN routine_only::INT ELSE 0 END",
    f"CASE WHEN {_SEEN} THEN CASE o WHEN 'match_win' THEN win::INT WHEN 'elimination' THEN 0.6 WHEN 'death_or_fail' THEN 0.5 ELSE 0 END ELSE 0 END",
    "CASE WHEN v NOT IN ('', 'skip') THEN greatest(CASE o WHEN 'match_win' THEN CASE WHEN win THEN 1.0::DOUBLE ELSE 0 END WHEN 'elimination' THEN 0.6 WHEN 'death_or_fail' THEN 0.5 ELSE 0 END, CASE WHEN verbal AND NOT chatty THEN visual_payoff * (0.6 + 0.4 * visual_contained) ELSE 0 END) ELSE 0 END",
    f"CASE WHEN {_SEEN} THEN anchored::INT ELSE 0 END", "0", "0",
]


@P.add(f"""WITH {_CANDIDATES}, x AS (SELECT id, [{", ".join(f"({e})::DOUBLE" for e in _VECTOR)}] AS f FROM evidence), y AS (SELECT id, f, unnest(range(1, 33)) AS place FROM x) SELECT id, place::INT AS place, round(f[place] + 1e-9, 6)::DOUBLE AS value FROM y""")
def candidate_vectors(spark, sf_dir):
    """Every candidate's 32 features, by place."""
    x = editorial.with_evidence(candidates.with_score(_candidates(spark, sf_dir)))
    v = features.candidate_features(x).select("id", F.posexplode("features").alias("place", "value"))
    return v.select("id", (F.col("place") + 1).alias("place"), F.round(F.col("value") + 1e-9, 6).alias("value"))


@P.add()
def whole_deck(spark, sf_dir):
    """Every candidate's group, place, disposition and window, from gates and floors to the ceiling and rescues."""
    x = decks.deck(deck_rows(spark, sf_dir), ["user_id"], editorial.floor_keep(F.col("score"), F.col("floor")), replace(DECK, ceiling=2, rich_events=2), MOMENT, 100000.0)
    return x.select("user_id", "id", "group", "place", "disposition", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "rank")


QUERIES, ORACLE = P.queries, P.oracle
