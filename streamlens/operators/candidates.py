"""Clip candidates: signal score, evidence gates as arrays of failed reasons, and vetoes, all as Columns.

A candidate row may lack any of the columns below; what is missing counts as null. Thresholds are
parameters with fixed default values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.functions.scoring import clip
from streamlens.functions.structures import keep_only, labels
from streamlens.operators import editorial
from streamlens.operators.editorial import EVENTS, LOBBY, Evidence


@dataclass(frozen=True)
class Tuning:
    """Fixed default thresholds and weights of scoring and gating."""

    peak_weight: float = 1.5
    game_bonus: float = 0.5
    density_weight: float = 0.55
    dead_air_weight: float = 0.35
    dead_air_free: float = 0.35
    duration_weight: float = 0.35
    payoff_weight: float = 0.20
    padded_penalty: float = 0.40
    lobby_penalty: float = 2.5
    crowd_bonus: float = 0.5
    startle_weight: float = 8.0
    visible_crowd_weight: float = 1.5
    min_peak: float = 0.55
    min_score: float = 0.75
    min_agreement: float = 0.50
    event_min_agreement: float = 0.40
    min_modalities: int = 2
    agreement_cap: int = 4
    max_dead_air: float = 0.65
    event_max_dead_air: float = 0.50
    lobby_max_duration: float = 15.0
    event_min_mean: float = 0.55
    pad_exempt_crowd: int = 2


#: The gates in their order (fixed values): those marked structural stay whatever else speaks for a candidate, those marked kept outlast a rescue.
GATES: dict[str, tuple[bool, bool]] = {
    "housekeeping": (True, True),
    "terminal_non_content": (True, True),
    "routine_non_gameplay": (True, False),
    "routine_non_gameplay_ocr": (True, False),
    "peak_floor": (False, False),
    "score_floor": (False, False),
    "modality_gate": (False, False),
    "dead_air": (False, False),
    "lobby_length": (False, False),
    "floor_padded": (False, False),
    "incomplete_beat": (True, True),
    "visual_filler": (True, True),
    "routine_event": (False, False),
    "non_event_chatter": (True, True),
    "unpublishable_beat": (True, True),
    "semantic_reject": (False, False),
    "visual_skip": (False, False),
}
STRUCTURAL = [name for name, (structural, _) in GATES.items() if structural]
RESCUED = [name for name, (_, kept) in GATES.items() if kept]

#: Optional columns and their values when missing.
DEFAULTS: dict[str, tuple[str, object]] = {
    "peak_value": ("double", 0.0), "reaction_auc": ("double", 0.0), "event_density": ("double", 1.0), "game_evidence": ("double", 0.0), "dead_air_ratio": ("double", 1.0),
    "game_label": ("string", None), "scene_label": ("string", None), "floor_padded": ("boolean", False), "crowd_clip": ("int", 0), "startle": ("double", 0.0), "visible_crowd": ("double", 0.0),
    "signal_agreement": ("double", 0.0), "modality_count": ("int", 0), "active_channels": ("int", 1), "text_verdict": ("string", None), "text_type": ("string", None), "verdict": ("string", None),
    "hook": ("double", 0.0), "payoff": ("double", 0.0), "self_contained": ("double", 0.0), "anchor": ("double", None), "housekeeping": ("boolean", False), "terminal": ("boolean", False),
}


def complete(df: DataFrame) -> DataFrame:
    """All optional columns, with defaults for missing ones and nulls."""
    for name, (kind, default) in DEFAULTS.items():
        value = F.lit(default).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name).cast(kind), value) if name in df.columns else value)
    return df


def duration_prior(d: Column) -> Column:
    """0 up to 8 s, rising to 1 at 14 s, 1 up to 45 s, falling to .4 at 90 s."""
    return F.when(d <= 8, 0.0).when(d < 14, (d - 8) / 6).when(d <= 45, 1.0).when(d >= 90, 0.4).otherwise(1 - 0.6 * (d - 45) / 45)


def payoff_position(start: Column, duration: Column, anchor: Column, is_event: Column) -> Column:
    """Where in the clip the anchor stands: events want it between .35 and .85, others between .30 and .75."""
    p = clip((anchor - start) / duration, 0.0, 1.0)
    event = F.when(p.between(0.35, 0.85), 1.0).when(p < 0.20, -0.6).when(p > 0.92, -0.3).otherwise(0.2)
    return F.coalesce(F.when(is_event, event).otherwise(F.when(p.between(0.30, 0.75), 0.35).otherwise(0.0)), F.lit(0.0))


def with_score(df: DataFrame, t: Tuning = Tuning()) -> DataFrame:
    """duration, mean_intensity and signal_score of completed candidates with start and end."""
    d = F.greatest(F.lit(1.0), F.col("end") - F.col("start"))
    is_event = F.coalesce(F.col("game_label").isin(EVENTS), F.lit(False))
    score = (
        t.peak_weight * F.col("peak_value")
        + F.col("reaction_auc") / d
        + t.game_bonus * F.col("game_evidence")
        + t.density_weight * F.greatest(F.lit(0.0), F.col("event_density") - 1)
        - t.dead_air_weight * F.greatest(F.lit(0.0), F.col("dead_air_ratio") - t.dead_air_free)
        + t.duration_weight * duration_prior(d)
        + t.payoff_weight * payoff_position(F.col("start"), d, F.col("anchor"), is_event)
        - F.when(F.col("floor_padded"), t.padded_penalty).otherwise(0.0)
        - F.when(F.col("scene_label").isin(LOBBY), t.lobby_penalty).otherwise(0.0)
        + t.crowd_bonus * F.least(F.greatest(F.col("crowd_clip"), F.lit(0)), F.lit(3)) / 3
        + t.startle_weight * F.col("startle")
        + t.visible_crowd_weight * F.col("visible_crowd")
    )
    return df.withColumn("duration", d).withColumn("mean_intensity", F.col("reaction_auc") / d).withColumn("signal_score", score)


def agrees(is_event: Column, t: Tuning = Tuning()) -> Column:
    """Enough channels take part: a share of the active ones (at most four count), two for ordinary clips, one for events."""
    active = F.greatest(F.lit(1), F.col("active_channels"))
    count = F.when(F.col("modality_count") > 0, F.col("modality_count")).otherwise(F.floor(F.col("signal_agreement") * active + 0.5))
    need = lambda share: F.ceil(share * F.least(active, F.lit(t.agreement_cap)) - 1e-9)
    return F.when(is_event, count >= F.greatest(F.lit(1), need(t.event_min_agreement))).otherwise(count >= F.greatest(F.least(F.lit(t.min_modalities), active), need(t.min_agreement)))


def with_gates(df: DataFrame, bar: Column | float = 0.0, t: Tuning = Tuning(), e: Evidence = Evidence()) -> DataFrame:
    """reasons: the gates that a scored candidate fails, in the order of GATES; strong evidence for it leaves only those that outlast a rescue."""
    df = editorial.with_evidence(df, e)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    strong = F.col("is_event") & (F.col("game_evidence") >= 0.5) & (F.col("dead_air_ratio") <= t.event_max_dead_air)
    bar = F.lit(bar) if not isinstance(bar, Column) else bar
    override = F.col("crowd_anchor") | (text("verdict").isin("post", "maybe") & F.col("grounded"))
    rejected = (text("text_verdict") == "skip") & ((text("text_type") == "filler") | (text("verdict") == "skip")) & ~override
    skipped = (text("verdict") == "skip") & ~F.coalesce("speech_unheard", F.lit(False)) & ~F.col("gate_bypass") & ~F.col("skip_conflict")
    fails = {
        "housekeeping": F.col("housekeeping"),
        "terminal_non_content": F.col("terminal") & ~F.col("real_beat"),
        "routine_non_gameplay": F.col("waiting_agreed"),
        "routine_non_gameplay_ocr": F.col("waiting_ocr") & ~F.col("waiting_agreed"),
        "peak_floor": F.col("peak_value") < F.greatest(bar, F.lit(t.min_peak)),
        "score_floor": F.col("signal_score") < t.min_score,
        "modality_gate": ~agrees(strong, t),
        "dead_air": F.col("dead_air_ratio") > t.max_dead_air,
        "lobby_length": F.col("scene_label").isin(LOBBY) & (F.col("duration") > t.lobby_max_duration) & ~F.col("lobby_reaction"),
        "floor_padded": F.col("floor_padded") & ~strong & (F.col("crowd_clip") < t.pad_exempt_crowd),
        "incomplete_beat": F.col("incomplete"),
        "visual_filler": F.col("generic_filler"),
        "routine_event": F.col("is_event") & (F.col("mean_intensity") < t.event_min_mean),
        "non_event_chatter": F.col("chat_only") & ((text("text_verdict") == "skip") | (text("text_type") == "filler") | ~F.col("grounded")),
        "unpublishable_beat": F.col("text_verdict").isNotNull() & (text("verdict") != "") & ~F.col("publishable"),
        "semantic_reject": rejected,
        "visual_skip": skipped,
    }
    failed = labels(*[(fails[name], name) for name in GATES])
    rescued = ~skipped & ~rejected & (F.col("text_rescue") | F.col("crowd_anchor") | F.col("gate_bypass"))
    return df.withColumn("all_reasons", failed).withColumn("reasons", F.when(rescued, keep_only(F.col("all_reasons"), RESCUED)).otherwise(F.col("all_reasons"))).drop("all_reasons")


def creator_reasons(reasons: Column) -> Column:
    """A creator's own marker leaves structural reasons only."""
    return keep_only(reasons, STRUCTURAL)


def crowd_reasons(reasons: Column, both_skip: Column) -> Column:
    """A viewers' request keeps structural reasons, and the visual skip when the text judge agrees."""
    return F.when(both_skip, keep_only(reasons, [*STRUCTURAL, "visual_skip"])).otherwise(keep_only(reasons, STRUCTURAL))


def second_look_reason(hook: Column, voice: Column, agreement: Column) -> Column:
    """The first of three fixed floors that a second-look candidate is under, else null."""
    return F.coalesce(F.when(hook <= 0.2162, "hook_floor"), F.when(voice <= 0.1375, "voice_floor"), F.when(agreement <= 0.4, "agreement_floor"))
