"""What a moment is and how it is shown: kinds, strength, sign-offs, features, judged windows, sampled times, repaired model output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from streamlens.functions.scoring import clip
from streamlens.functions.strings import clean, tokens

#: What a result screen says.
WIN = r"(?i)VICTORY\s*ROYALE|#\s*1\s+VICTORY"
TERMINAL = r"(?i)GAME OVER|YOU\s*PLACED\s*#?\s*(\d+)|VICTORY\s*ROYALE|#\s*1\s+VICTORY"
MILESTONE = r"(?i)(\d+)\s+Eliminations?\s+in\s+a"
#: The weight of a tag in a moment's strength.
TAGS = {"clutch": 0.7, "story": 0.4, "funny": 0.35, "rage": 0.3, "scare": 0.25, "wholesome": 0.2, "fail": -0.2}
#: Ordinals of labels and moment types among a ranker's features.
TIER_ORDINAL = {"generic_highlight": 0.2, "rank_progress": 0.4, "knock": 0.6, "elimination": 0.8, "terminal_win": 1.0}
TYPE_ORDINAL = {"filler": 0.0, "story": 0.45, "wholesome": 0.65, "fail": 0.70, "rage": 0.75, "scare": 0.85, "funny": 0.95, "clutch": 1.0}
#: Sign-offs count anywhere, logistics near both ends of a recording, greetings near its start.
SIGN_OFF = ["thanks for watching", "thank you for watching", "thanks for tuning in", "see you next time", "see you guys next", "see you next stream", "see you tomorrow", "catch you later", "end the stream", "ending the stream", "call it a night", "gonna head out", "gonna wrap it up", "good stream everyone", "appreciate you all"]
LOGISTICS = ["next stream", "join my discord", "join the discord", "follow me on", "hit that follow", "make sure to follow", "make sure to subscribe", "check the description", "link in the description", "gonna raid", "go raid"]
GREETING = ["welcome back", "welcome in", "how's everyone doing", "can you guys hear me", "testing the mic", "is my audio", "we are live", "starting the stream", "just getting started"]


def _mapped(x: Column, values: dict[str, float]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[x], F.lit(0.0))


def moment_kind(title: Column, text: Column, ocr: Column, events: Column) -> Column:
    """win, elimination, lobby, terminal or event. ocr and events: arrays; without ocr the text is read."""
    seen = F.when(F.size(ocr) > 0, F.array_join(ocr, " ")).otherwise(F.coalesce(text, F.lit("")))
    named = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    low = F.transform(events, F.lower)
    lobby = (named == "lobby") | (F.coalesce(text, F.lit("")).rlike(r"(?i)\blobby\b") & ~F.array_contains(low, "elimination"))
    return F.when(seen.rlike(WIN) | F.array_contains(low, "terminal win"), "win").when((named == "elimination") | F.array_contains(low, "elimination"), "elimination").when(lobby, "lobby").when(seen.rlike(TERMINAL), "terminal").otherwise("event")


def milestone(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MILESTONE), F.lit(1)), lambda d: d.cast("int")))


def moment_strength(multiple: Column, reactions: Column, audio: Column, motion: Column, tags: Column, has_milestone: Column) -> Column:
    """1 and more for a multiple, bursts, audio spikes, how loud and lively it was, its tags and a milestone."""
    said = lambda word: F.size(F.filter(reactions, lambda r: F.contains(F.lower(r), F.lit(word))))
    tagged = reduce(lambda a, b: a + b, [F.when(F.array_contains(tags, t), w).otherwise(0.0) for t, w in TAGS.items()])
    return 1 + 0.45 * F.least(multiple - 1, F.lit(3)) + 0.30 * said("burst") + 0.20 * said("audio spike") + 0.35 * F.least(audio, F.lit(3.0)) + 0.25 * F.least(motion, F.lit(1.0)) + tagged + F.when(has_milestone, 0.15).otherwise(0.0)


def housekeeping(text: Column, start: Column, end: Column, length: Column, boundary: float = 180.0) -> Column:
    """sign_off, logistics or greeting when the words say so where it counts, else null."""
    said = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    any_of = lambda phrases: reduce(lambda a, b: a | b, [F.contains(said, F.lit(f" {p} ")) for p in phrases])
    head, tail = start <= boundary, (length > 0) & (end >= length - boundary)
    return F.when(any_of(SIGN_OFF), "sign_off").when(any_of(LOGISTICS) & (head | tail), "logistics").when(any_of(GREETING) & head, "greeting")


def display_score(f: dict[str, Column]) -> Column:
    """A clip's shown score, .45 to .98, from peak_value, mean_intensity, game_tier, signal_agreement, dead_air_ratio, payoff_position and is_win."""
    low = lambda c: F.least(F.lit(1.0), c)
    shape = F.greatest(F.lit(0.0), 1 - F.abs(f["payoff_position"] - 0.68) / 0.68)
    raw = 0.28 * low(f["peak_value"] / 3.0) + 0.24 * low(f["mean_intensity"] / 2.2) + 0.18 * low(f["game_tier"]) + 0.14 * low(f["signal_agreement"] / 0.75) + 0.10 * (1 - low(f["dead_air_ratio"])) + 0.06 * shape
    return clip(F.when(f["is_win"] >= 1.0, F.greatest(raw, F.lit(0.82))).otherwise(raw), 0.45, 0.98)


def ranker_features(c: dict[str, Column]) -> dict[str, Column]:
    """Named features of a candidate with start, end, peak, anchor (may be null), auc, peak_value, label, moment_type, dead_air and agreement; a missing dead air counts as all."""
    d = F.greatest(F.lit(1.0), c["end"] - c["start"])
    place = lambda t: clip((t - c["start"]) / d, 0.0, 1.0)
    return {
        "peak_value": F.coalesce(c["peak_value"], F.lit(0.0)), "mean_intensity": c["auc"] / d, "duration": d, "game_tier": _mapped(c["label"], TIER_ORDINAL), "is_win": F.coalesce((c["label"] == "terminal_win").cast("double"), F.lit(0.0)),
        "peak_position": place(c["peak"]), "payoff_position": place(F.coalesce(c["anchor"], c["peak"])), "dead_air_ratio": F.coalesce(c["dead_air"], F.lit(1.0)), "signal_agreement": F.coalesce(c["agreement"], F.lit(0.0)), "moment_type": _mapped(c["moment_type"], TYPE_ORDINAL),
    }


def judged_window(start: Column, end: Column, prepared_start: Column, prepared_end: Column, peak: Column) -> Column:
    """The prepared cut when it is a window around the peak, else the candidate's own."""
    a = F.greatest(F.lit(0.0), start)
    b = F.greatest(a + 0.1, end)
    fine = (prepared_end > prepared_start) & peak.between(prepared_start, prepared_end)
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(F.greatest(F.lit(0.0), prepared_start).alias("start"), prepared_end.alias("end"))).otherwise(F.struct(a.alias("start"), b.alias("end")))


#: Where the looks at a window fall: role, its slot among count looks, and whether it needs a time of its own. Of roles in one slot the first counts.
LOOKS = [("banner", lambda n: min(n - 1, n // 2 + 1)), ("peak", lambda n: n // 2), ("approach", lambda n: max(1, n // 2 - 1)), ("opening", lambda n: 0)]


def milli(t: Column) -> Column:
    """t to the nearest thousandth of its double, as SQL engines round it; F.round goes by the shortest decimal that prints as t, which may lie on a tie where the double does not."""
    return F.round(t * 1000.0) / 1000.0


def look_times(start: Column, end: Column, peak: Column, witness: Column, expected: Column, count: int = 6) -> Column:
    """array of (t, role) at which to look at a window, in order of time and .05 apart: its opening, the approach to the peak, the peak, the banner (witnessed, or a second after
    the event it is expected for) when it lies inside, and slots spread evenly. count is held to 2..8; with two looks there are only opening and peak."""
    n = max(2, min(8, count))
    length = end - start
    centre = F.when(peak.between(start, end), peak).otherwise(start + length * 0.55)
    shown = F.coalesce(witness, expected + 1.0)
    inset = lambda most, part: F.least(F.lit(most), length * part)
    when = {"opening": start + (F.lit(0.5) if n == 2 else inset(0.5, 0.05)), "peak": centre, "approach": centre - inset(1.0, 0.08), "banner": F.when(shown.between(start, end), shown)}
    roles = [(r, slot(n)) for r, slot in LOOKS if n > 2 or r in ("opening", "peak")]
    held = lambda t: milli(F.greatest(start + inset(0.15, 0.02), F.least(end - inset(0.15, 0.02), t)))

    def look(slot: int) -> Column:
        own = [F.when(when[r].isNotNull(), F.struct(held(when[r]).alias("t"), F.lit(r).alias("role"))) for r, s in roles if s == slot]
        return F.coalesce(*own, F.struct(held(start + length * (slot / n)).alias("t"), F.lit("spread").alias("role")))

    looks = F.array_sort(F.array(*[look(k) for k in range(n)]))
    apart = lambda kept, x: F.when(F.exists(kept, lambda k: x["t"] - k["t"] < 0.05), kept).otherwise(F.array_append(kept, x))
    return F.aggregate(looks, F.array().cast("array<struct<t:double,role:string>>"), apart)


def speech_windows(start: Column, end: Column, length: Column, width: float = 1.5, hop: float = 0.75, least: float = 1.0) -> Column:
    """Array of (start, end): windows every hop inside a stretch of speech, the last one flush with its end when more than .25 is left; short stretches are one window."""
    span = end - start
    n = F.floor((span - width + 1e-6) / hop).cast("int") + 1
    grid = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda k: F.struct((start + k * hop).alias("start"), (start + k * hop + width).alias("end")))
    last = start + (n - 1) * hop + width
    flush = F.when(last < end - 0.25, F.array(F.struct((end - width).alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:double,end:double>>"))
    a = F.least(F.greatest(F.lit(0.0), (start + end) / 2 - least / 2), F.greatest(F.lit(0.0), length - least))
    return F.when(span >= width, F.concat(grid, flush)).when(span >= least, F.array(F.struct(start.alias("start"), end.alias("end")))).when(span > 0, F.array(F.struct(a.alias("start"), (a + least).alias("end")))).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def stage_remaining(rate: Column, length: Column, elapsed: Column, progress: Column, later: Column) -> Column:
    """Seconds left of a job: half measured, half expected for the stage that runs, and what later stages usually take; null without either."""
    expected = rate * length
    measured = F.when((progress > 0.1) & (elapsed > 5), elapsed / progress)
    total = F.when(measured.isNotNull() & (expected > 0), 0.5 * measured + 0.5 * expected).otherwise(F.coalesce(measured, F.when(expected > 0, expected)))
    return F.least(F.greatest(F.lit(0.0), total - elapsed) + later, F.lit(6.0 * 3600))


def shown_text(x: Column, limit: int, least: int = 8) -> Column:
    """A description to show: empty when too short, else cut at a word's end without trailing marks."""
    text = clean(x)
    cut = F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(F.regexp_extract(F.concat(F.left(text, F.lit(limit + 1)), F.lit("")), rf"^(.{{0,{limit}}})(?=\s|$)|^(.*)\s", 1), "[ ,;:-]+$", ""))
    return F.when(F.length(text) < least, "").otherwise(cut)


def rewritten(x: Column, words: dict[str, str]) -> Column:
    """Words replaced by a dictionary (lower case), with the case of what they replace: upper, capital or as they are."""
    table = F.create_map(*[F.lit(v) for pair in words.items() for v in pair])

    def one(w: Column) -> Column:
        core = F.regexp_extract(w, r"[\p{L}']+", 0)
        new = table[F.lower(core)]
        cased = F.when((core == F.upper(core)) & (F.length(core) > 1), F.upper(new)).when(F.left(core, F.lit(1)) == F.upper(F.left(core, F.lit(1))), F.concat(F.upper(F.left(new, F.lit(1))), F.substring(new, 2, 1 << 20))).otherwise(new)
        return F.when(new.isNotNull(), F.replace(w, core, cased)).otherwise(w)

    return F.array_join(F.transform(F.split(F.coalesce(x, F.lit("")), " "), one), " ")


def verdict_struct(text: Column, kinds: list[str], verdicts: list[str]) -> Column:
    """A judge's JSON as (hook, contained, payoff, kind, verdict), numbers held in 0..1; fences and words around the object are dropped, and an object that breaks off is closed. Null when kind or verdict is not known."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*)", 1)
    whole = F.regexp_extract(body, r"(?s)^(\{.*\})", 1)
    fields = "hook_strength double, self_contained double, payoff double, moment_type string, verdict string"
    parse = lambda t: F.from_json(t, fields, {"mode": "PERMISSIVE"})
    pairs = F.regexp_extract(body, r"(?s)^(\{(?:\s*\"[^\"]*\"\s*:\s*(?:\"[^\"]*\"|[^\",{}]+)\s*,)*)", 1)
    fixed = F.when(whole != "", whole).otherwise(F.concat(F.regexp_replace(pairs, r",\s*$", ""), F.lit("}")))
    v = parse(fixed)
    kind, verdict = F.lower(F.trim(v["moment_type"])), F.lower(F.trim(v["verdict"]))
    unit = lambda c: clip(F.coalesce(c, F.lit(0.0)), 0.0, 1.0)
    return F.when(kind.isin(kinds) & verdict.isin(verdicts), F.struct(unit(v["hook_strength"]).alias("hook"), unit(v["self_contained"]).alias("contained"), unit(v["payoff"]).alias("payoff"), kind.alias("kind"), verdict.alias("verdict")))
