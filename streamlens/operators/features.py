"""What rankers read of a candidate: 32 named numbers in a fixed order, and which stored ones may still be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.functions.moments import TIER_ORDINAL, TYPE_ORDINAL
from streamlens.functions.scoring import clip
from streamlens.operators import editorial

#: The features in their order.
NAMES = [
    "face", "voice", "speech", "game", "peak_value", "mean_intensity", "reaction_auc", "duration", "game_tier", "is_win", "peak_position", "payoff_position", "lead_reaction", "settle_reaction", "dead_air_ratio", "signal_agreement",
    "hook_score", "self_contained", "payoff", "moment_type_ordinal", "vod_median", "vod_mad", "active_channel_count", "vod_duration_norm", "presentation_rank",
    "visual_win", "visual_routine_only", "visual_outcome_strength", "content_interest", "content_anchor", "speech_rate_delta", "exclaim_ratio",
]
#: Those that a row from before they were counted may lack (they count as 0 then), and versions of stored rows that hold all that is needed.
LATER = ["visual_win", "visual_routine_only", "visual_outcome_strength", "content_interest", "content_anchor"]
VERSION, LOSSLESS = 8, [8, 7]
#: How much a visible outcome says.
OUTCOME = {"match_win": 1.0, "elimination": 0.6, "death_or_fail": 0.5}


def _mapped(x: Column, values: dict[str, float]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[x], F.lit(0.0))


def candidate_features(df: DataFrame, e: editorial.Evidence = editorial.Evidence(), out: str = "features") -> DataFrame:
    """df (rows of editorial.with_evidence) with an array of the features in the order of NAMES.

    Read where they are there: face, voice, speech, game, lead_reaction, settle_reaction, hook, self_contained, payoff, text_moment_type, vod_median, vod_mad, active_channels, vod_duration, speech_rate_delta and
    exclaim_ratio; what is missing counts as 0, a missing dead air as all of it, missing channels as one. The order of presentation is 0 here; only training rows know it.
    """
    have = set(df.columns)
    num = lambda c, default=0.0: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in have else F.lit(default)
    length = F.greatest(F.lit(1.0), F.col("end") - F.col("start"))
    place = lambda t: clip((t - F.col("start")) / length, 0.0, 1.0)
    seen = F.trim(F.coalesce("verdict", F.lit(""))) != ""
    outcome = F.lower(F.trim(F.coalesce("outcome", F.lit(""))))
    shown = lambda c: F.when(seen, c).otherwise(0.0)
    peak = F.coalesce("peak", "start")
    value = {
        **{c: num(c) for c in ("face", "voice", "speech", "peak_value", "reaction_auc", "lead_reaction", "settle_reaction", "signal_agreement", "self_contained", "payoff", "vod_median", "vod_mad", "speech_rate_delta", "exclaim_ratio")},
        "game": F.when(num("game_evidence") != 0, num("game_evidence")).otherwise(num("game")), "mean_intensity": num("reaction_auc") / length, "duration": length, "game_tier": _mapped(F.col("game_label"), TIER_ORDINAL),
        "is_win": F.coalesce((F.col("game_label") == "terminal_win").cast("double"), F.lit(0.0)), "peak_position": place(peak), "payoff_position": place(F.coalesce(F.col("anchor"), peak)), "dead_air_ratio": num("dead_air_ratio", 1.0), "hook_score": num("hook"),
        "moment_type_ordinal": _mapped(F.col("text_moment_type"), TYPE_ORDINAL) if "text_moment_type" in have else F.lit(0.0), "active_channel_count": F.when(num("active_channels") != 0, num("active_channels")).otherwise(1.0),
        "vod_duration_norm": F.least(F.lit(12.0), num("vod_duration") / 3600.0), "presentation_rank": F.lit(0.0),
        "visual_win": shown(F.col("visual_win").cast("double")), "visual_routine_only": shown(F.coalesce(F.col("routine_only"), F.lit(False)).cast("double")),
        "visual_outcome_strength": shown(F.when((outcome == "match_win") & ~F.col("visual_win"), 0.0).otherwise(_mapped(outcome, OUTCOME))),
        "content_interest": shown(clip(editorial.content_interest(e), 0.0, 1.0)), "content_anchor": shown(F.col("content_anchor").cast("double")),
    }
    return df.withColumn(out, F.array(*[value[n].cast("double") for n in NAMES]))


def stored_features(features: Column, version: Column) -> Column:
    """A stored map of features as an array in the order of NAMES: whole rows of a version that loses nothing; null for others."""
    whole = version.isin(LOSSLESS) & F.forall(F.array(*map(F.lit, NAMES)), lambda n: F.map_contains_key(features, n))
    return F.when(F.coalesce(whole, F.lit(False)), F.array(*[features[F.lit(n)].cast("double") for n in NAMES]))


def padded_features(features: Column) -> Column:
    """The same for rows without a version: those that lack only LATER features have 0 there; what else is missing was never measured, and makes the row null."""
    needed = [n for n in NAMES if n not in LATER]
    whole = F.forall(F.array(*map(F.lit, needed)), lambda n: F.map_contains_key(features, n))
    values = [F.coalesce(F.try_element_at(features, F.lit(n)).cast("double"), F.lit(0.0)) if n in LATER else features[F.lit(n)].cast("double") for n in NAMES]
    return F.when(F.coalesce(whole, F.lit(False)), F.array(*values))
