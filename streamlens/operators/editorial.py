"""Editorial evidence of clip candidates: what two judges, the screen and the signals say together, as boolean Columns.

A visual judge's fields are verdict, outcome, moment_type, onscreen, confidence, visual_payoff, visual_contained, context_complete,
routine_only, verbal_payoff, visual_event, streamer_reaction and model_verdict; a text judge's are text_verdict, text_type, hook, payoff and
self_contained. A missing judge is null. Everything is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a banner must read like to be a win, and what it must not; waiting screens; story cards.
WIN_TEXT = r"(?i)victor|champion|\bwinner\b|#\s*1\b|\b1st\b"
PLACED_TEXT = r"(?i)placed|defeat|eliminated|#\s*([2-9]\b|\d{2,})|\b([2-9]|\d{2,})(th|nd|rd)\b"
WAITING_TEXT = r"(?i)\b(loading|connecting|waiting\s+for\s+players|matchmaking|finding\s+match|searching\s+for\s+match|main\s+menu)\b"
CARD_TEXT = r"(?i)\b(rip\b|game\s*over|you\s+died|chapter\b|ending\b)"
EVENTS = ["elimination", "knock", "rank_progress", "terminal_win"]
LOBBY = ["lobby", "intermission"]


@dataclass(frozen=True)
class Evidence:
    """Fixed default thresholds of the evidence predicates."""

    confidence: float = 0.45
    payoff: float = 0.55
    contained: float = 0.50
    soft_payoff: float = 0.45
    event_startle: float = 0.15
    event_peak: float = 2.5
    win_startle: float = 0.10
    win_peak: float = 1.2
    strong_startle: float = 0.60
    crowd: float = 0.72
    face: float = 0.40
    face_run: int = 2
    face_delta: float = 0.20
    chat_voice: float = 0.15
    chat_face: float = 0.22
    verdict_payoff: float = 0.70
    both_contained: float = 0.70
    text_payoff: float = 0.60
    text_contained: float = 0.50
    text_hook: float = 0.45
    waiting_share: float = 0.60
    content_axis: bool = True
    narrative: bool = False
    text_authority: bool = True


#: Columns read here, with their types; what a table lacks is null.
FIELDS: dict[str, str] = {
    "verdict": "string", "outcome": "string", "moment_type": "string", "onscreen": "string", "model_verdict": "string", "profile": "string", "confidence": "double", "visual_payoff": "double", "visual_contained": "double",
    "context_complete": "boolean", "routine_only": "boolean", "verbal_payoff": "boolean", "visual_event": "boolean", "streamer_reaction": "boolean", "speech_unheard": "boolean", "capped": "boolean",
    "voice": "double", "face_max": "double", "face_p99": "double", "face_run": "int", "face_delta": "double", "burst": "double", "loud_onset": "double", "motion": "double", "game_audio": "double",
    "waiting_share": "double", "ranker_score": "double",
}


def _text(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def _num(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def with_evidence(df: DataFrame, t: Evidence = Evidence()) -> DataFrame:
    """Candidates (completed, with duration and mean_intensity) and the boolean columns that the gates and pools read."""
    df = df.withColumns({n: F.lit(None).cast(k) for n, k in FIELDS.items() if n not in df.columns})
    verdict, outcome, kind = _text("verdict"), _text("outcome"), _text("moment_type")
    text_verdict, text_type = _text("text_verdict"), _text("text_type")
    screen = F.coalesce(F.col("onscreen"), F.lit(""))
    label = F.coalesce(F.col("game_label").isin(EVENTS), F.lit(False))
    lobby = F.coalesce(F.col("scene_label").isin(LOBBY), F.lit(False))
    seen = verdict != ""
    endorsed = verdict.isin("post", "maybe")
    beat = (_num("confidence") >= t.confidence) & _is("verbal_payoff") & _is("context_complete") & ~_is("routine_only") & (_num("visual_contained") >= t.contained)
    df = df.withColumns({
        "is_event": label,
        "visual_win": (outcome == "match_win") & screen.rlike(WIN_TEXT) & ~screen.rlike(PLACED_TEXT),
        "strong_startle": _num("startle") >= t.strong_startle,
        "crowd_anchor": _num("visible_crowd") >= t.crowd,
        "verbal_complete": beat & (_num("visual_payoff") >= t.payoff),
        "spoken_beat": beat & ((_num("visual_payoff") >= t.payoff) | ((kind == "story") & (_num("visual_payoff") + 1e-9 >= t.soft_payoff))),
        "face_spike": F.coalesce((_num("face_max") >= F.greatest(F.lit(t.face), F.col("face_p99"))) & (F.col("face_run") >= t.face_run) & (F.col("face_delta") >= t.face_delta) & F.col("face_p99").isNotNull(), F.lit(False)),
        "text_complete": (text_verdict == "post") & (text_type != "filler") & (_num("payoff") >= t.text_payoff) & (F.coalesce("self_contained", "visual_contained", F.lit(0.0)) >= t.text_contained),
        "text_rescue": F.lit(t.text_authority) & (text_verdict == "post") & (text_type != "filler") & (_num("hook") >= t.text_hook) & (_num("payoff") >= t.text_payoff) & (_num("self_contained") >= t.text_contained),
        "lobby_reaction": lobby & (_num("peak_value") >= 1.25) & (F.col("mean_intensity") >= 0.75) & (_num("signal_agreement") >= 0.65) & (F.col("dead_air_ratio") <= 0.30) & (_num("burst") >= 0.15) & (F.greatest(_num("motion"), _num("game_audio")) >= 0.20),
        "observed_reaction": (_num("peak_value") >= 1.25) & (F.col("mean_intensity") >= 0.75) & (_num("signal_agreement") >= 0.65) & (F.col("dead_air_ratio") <= 0.45),
        "waiting_ocr": (_num("waiting_share") >= t.waiting_share) & ~endorsed & (text_verdict != "post"),
        "waiting_agreed": (lobby | (outcome == "menu_or_shop") | screen.rlike(WAITING_TEXT)) & (_text("model_verdict") == "skip") & (text_verdict == "skip") & (text_type == "filler"),
        "generic_filler": (_text("profile") == "generic") & (F.coalesce(F.col("game_label"), F.lit("")) == "") & (verdict == "maybe") & (kind == "filler") & outcome.isin("", "none"),
        "skip_conflict": (text_verdict == "post") & ~text_type.isin("", "filler") & outcome.isin("", "none") & F.col("ranker_score").isNotNull() & (_num("payoff") >= 0.70) & (_num("signal_agreement") >= 0.75) & (_num("peak_value") >= 2.50) & (_num("ranker_score") >= 0.70) & (_num("waiting_share") < 0.50),
    })
    df = df.withColumn("reaction_landed", F.when(F.col("visual_win"), (_num("startle") >= t.win_startle) | (_num("peak_value") >= t.win_peak)).when(label, (_num("startle") >= t.event_startle) | (_num("peak_value") >= t.event_peak)).otherwise(True))
    df = df.withColumn("landed_event", (F.col("visual_win") | label) & F.col("reaction_landed"))
    df = df.withColumn("grounded", F.col("landed_event") | F.col("spoken_beat") | F.col("strong_startle") | F.col("crowd_anchor") | F.col("face_spike"))
    chat_only = (
        endorsed & ~F.col("visual_win") & ~label & ~outcome.isin("match_win", "elimination", "death_or_fail") & ~_is("visual_event") & ~screen.rlike(CARD_TEXT) & ~F.col("strong_startle") & ~F.col("crowd_anchor")
        & (_num("voice") >= t.chat_voice) & ~(F.col("spoken_beat") & (_num("face_max") >= 0.15)) & (_num("face_max") < t.chat_face) & (_num("burst") < 0.35) & (_num("loud_onset") < 0.35)
    )
    consensus = (
        (verdict == "post") & F.col("grounded") & (_num("visual_payoff") >= t.verdict_payoff) & (_num("visual_contained") >= t.both_contained) & _is("context_complete") & ~_is("routine_only")
        & (text_verdict == "post") & (_num("payoff") >= t.text_payoff) & (_num("self_contained") >= t.both_contained)
    )
    df = df.withColumns({"chat_only": chat_only, "consensus": consensus})
    soft_story = ~_is("routine_only") & _is("context_complete") & (_num("confidence") >= t.confidence) & (_num("visual_payoff") + 1e-9 >= t.soft_payoff)
    narrative = F.lit(t.narrative) & ~_is("capped") & ~F.col("chat_only") & endorsed & ((outcome == "death_or_fail") | F.col("verbal_complete") | ((kind == "story") & soft_story))
    df = df.withColumn("narrative_beat", narrative)
    real_beat = F.col("strong_startle") | F.col("crowd_anchor") | F.col("landed_event") | (~_is("routine_only") & _is("context_complete") & (_num("visual_payoff") >= t.payoff) & (_num("visual_contained") >= t.contained) & (_is("verbal_payoff") | _is("streamer_reaction")))
    text_whole = (text_verdict == "post") & (text_type != "filler") & (_num("payoff") >= t.text_payoff) & (_num("self_contained") >= t.text_contained)
    any_beat = _is("verbal_payoff") | _is("visual_event") | _is("streamer_reaction") | ~outcome.isin("", "none")
    judged = seen | F.col("text_verdict").isNotNull()
    return df.withColumns({
        "gate_bypass": F.lit(t.content_axis) & seen & (F.col("consensus") | F.when(F.col("visual_win"), F.col("reaction_landed")).otherwise(F.col("narrative_beat"))),
        "content_anchor": F.lit(t.content_axis) & seen & ~_is("capped") & F.when(F.col("visual_win"), F.col("reaction_landed")).otherwise(~F.col("chat_only") & (F.col("verbal_complete") | F.col("narrative_beat"))),
        "publishable": F.col("landed_event") | F.col("grounded") | F.col("text_complete") | F.col("lobby_reaction") | F.col("observed_reaction"),
        "real_beat": real_beat,
        "incomplete": judged & ~real_beat & ((_is("routine_only") & ~text_whole) | (seen & ~_is("context_complete") & ~any_beat & ~text_whole)),
    })


def content_interest(t: Evidence = Evidence()) -> Column:
    """0 to 1 for rows of with_evidence: a visible outcome (a win that the screen confirms 1, an elimination .6, a death .5), or a complete spoken beat."""
    outcome = _text("outcome")
    seen = F.when(outcome == "match_win", F.when(F.col("visual_win"), 1.0).otherwise(0.0)).when(outcome == "elimination", 0.6).when(outcome == "death_or_fail", 0.5).otherwise(0.0)
    spoken = F.when(F.col("verbal_complete") & ~F.col("chat_only"), _num("visual_payoff") * (0.60 + 0.40 * _num("visual_contained"))).otherwise(0.0)
    return F.when(F.lit(t.content_axis) & ~_text("verdict").isin("", "skip"), F.greatest(seen, spoken)).otherwise(0.0)


def floor_keep(score: Column, floor: Column) -> Column:
    """Whether a judged candidate of with_evidence may stay under a deck's floor: true, false, or null where no judge saw it (the signals decide)."""
    verdict = _text("verdict")
    over = score >= floor
    judged = F.when(verdict == "post", F.col("grounded") | over).when(verdict == "maybe", score >= floor * F.when(F.col("grounded"), 0.5).otherwise(1.0)).otherwise(F.lit(False))
    return F.when(verdict == "", F.lit(None).cast("boolean")).when(~F.col("reaction_landed"), over).otherwise(judged)


def event_rich_allowed() -> Column:
    """Whether an ordinary candidate of with_evidence may enter a deck of a recording that is rich in events."""
    verdict = _text("text_verdict")
    direct = F.col("text_rescue") | F.col("strong_startle") | F.col("crowd_anchor") | F.col("lobby_reaction") | F.col("gate_bypass") | (_num("burst") >= 0.12)
    post = (_num("payoff") >= 0.35) & (_num("self_contained") >= 0.50)
    maybe = (_num("hook") >= 0.45) & (_num("payoff") >= 0.60) & (_num("self_contained") >= 0.70)
    signals = (_num("hook") >= 0.45) & (_num("signal_agreement") >= 0.50) & (F.col("dead_air_ratio") <= 0.45)
    return direct | F.when(verdict == "post", post).when(verdict == "maybe", maybe).when(verdict != "", F.lit(False)).otherwise(signals)


def face_spike_events(df: DataFrame, keys: list[str], t: str, merge: float = 8.0, most: int = 3) -> DataFrame:
    """keys and t of the face spikes that may rescue a clip: spikes at most merge seconds apart are one event, and of each key's events the
    strongest by (face_delta, face_run, face_max) count, most of them. df: rows of with_evidence."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(t)
    x = df.where("face_spike").withColumn("__e", F.sum(F.coalesce(F.col(t) - F.lag(t).over(w) > merge, F.lit(True)).cast("int")).over(w))
    strength = F.max(F.struct("face_delta", "face_run", "face_max"))
    best = x.groupBy(*keys, "__e").agg(strength.alias("__s")).withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__s"), "__e"))).where(F.col("__r") <= most)
    return x.join(best.select(*keys, "__e"), [*keys, "__e"], "left_semi").select(*keys, t)
