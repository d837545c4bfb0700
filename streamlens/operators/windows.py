"""Clip windows over per-second frames: statistics, face context, evidence tracks, onsets and settles, trims, sentences, credit for requests.

Frames have keys (a recording), t and channels; windows have keys, an id, start and end. Frames meet windows by a bucketed range join, so neither a
recording nor a window has to fit anywhere whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions.scoring import clip
from streamlens.operators import robust
from streamlens.operators.intervals import islands, points_in

#: Channels and the level from which each takes part in a reaction (fixed values).
CHANNELS = {"face": 0.12, "voice": 0.25, "speech": 0.20, "burst": 0.12, "chat": 2.5, "motion": 0.18}
#: Evidence of an event's tier, and the tiers that make a spot dense (fixed values).
TIERS = {"terminal_win": 1.0, "elimination": 0.7, "knock": 0.5, "rank_progress": 0.3, "generic_highlight": 0.2}
DENSE = ["elimination", "knock", "terminal_win"]
#: Words that a phrase of the hype lexicon may have.
MOST_WORDS = 12


def window_statistics(windows: DataFrame, frames: DataFrame, keys: list[str], hook: float = 5.0, quiet: float = 0.15, bucket: float = 60.0) -> DataFrame:
    """id and what the frames inside each window (ends included) say: means and maxima of channels (faces only where present), reaction before and from
    the pivot, share of quiet frames, channels that take part, and the opening's energy, burst and chat. windows: keys, id, start, end and pivot;
    frames: keys, t, score, present, game_evidence, game_audio, loud_onset, startle and the CHANNELS. A window without frames has zeros and is all dead air.

    Only channels that are active in a recording (above 0 in some frame; voice always) take part, and agreement is the share of these that do."""
    j = points_in(frames, windows, keys, "t", ("start", "end"), 0.0, bucket)
    face = F.when(F.col("present"), F.col("face"))
    level = lambda c: F.coalesce(face if c == "face" else F.col(c), F.lit(0.0))
    joins = {c: F.max((level(c) >= least).cast("int")) for c, least in CHANNELS.items()}
    on = {c: F.lit(1) if c == "voice" else F.max((level(c) > 0).cast("int")) for c in CHANNELS}
    active = frames.groupBy(*keys).agg(*[x.alias(f"on_{c}") for c, x in on.items()])
    opening = F.col("t") <= F.col("start") + hook
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = j.groupBy("id").agg(
        zero(F.avg(face)).alias("face"), zero(F.max(face)).alias("face_max"), *[F.avg(c).alias(c) for c in ("voice", "speech", "chat", "motion")], *[F.max(c).alias(c) for c in ("burst", "loud_onset", "startle", "game_audio")], F.max("game_evidence").alias("game"),
        zero(F.avg(F.when(F.col("t") < F.col("pivot"), F.col("score")))).alias("lead"), zero(F.avg(F.when(F.col("t") >= F.col("pivot"), F.col("score")))).alias("settle"),
        F.avg(((F.col("score") < quiet) & (F.col("game_evidence") <= 0)).cast("double")).alias("dead_air"), *[x.alias(f"in_{c}") for c, x in joins.items()],
        zero(F.avg(F.when(opening, F.greatest("score", F.lit(0.0))))).alias("hook_energy"), zero(F.max(F.when(opening, F.col("burst")))).alias("hook_burst"), zero(F.max(F.when(opening, F.col("chat")))).alias("hook_chat"), F.sum("score").alias("auc"),
    )
    out = windows.select("id", *keys).join(stats, "id", "left").join(active, keys, "left")
    taking = sum(F.coalesce(F.col(f"in_{c}") * F.col(f"on_{c}"), F.lit(0)) for c in CHANNELS)
    share = F.coalesce(taking / sum(F.col(f"on_{c}") for c in CHANNELS), F.lit(0.0))
    plain = [c for c in stats.columns if c != "id" and not c.startswith("in_")]
    return out.select("id", *[F.coalesce(c, F.lit(1.0 if c == "dead_air" else 0.0)).alias(c) for c in plain], taking.cast("int").alias("modalities"), share.alias("agreement"))


def face_context(windows: DataFrame, faces: DataFrame, keys: list[str], floor: float = 0.40, share: float = 0.99, radius: float = 30.0, gap: float = 1.5, bucket: float = 60.0) -> DataFrame:
    """id, peak, p99 (of the recording), local (median within radius outside the window, else the recording's), delta, frames at the threshold and
    the longest run of them at most gap apart. faces: keys, t and face of frames with a face."""
    whole = faces.groupBy(*keys).agg(F.percentile("face", share).alias("p99"), F.percentile("face", 0.5).alias("middle"))
    w = windows.select(*keys, "id", "start", "end").join(whole, keys, "left")
    near = points_in(faces, w, keys, "t", ("start", "end"), radius, bucket)
    inside = F.col("t").between(F.col("start"), F.col("end"))
    hot = inside & (F.col("face") >= F.greatest(F.lit(floor), F.coalesce("p99", F.lit(0.0))))
    runs = islands(near.where(hot), ["id"], ["t"], lambda o: F.col("t") - F.lag("t").over(o) > gap).groupBy("id", "island").agg(F.count("*").alias("n")).groupBy("id").agg(F.max("n").alias("run"), F.sum("n").alias("hot"))
    stats = near.groupBy("id").agg(F.max(F.when(inside, F.col("face"))).alias("peak"), F.percentile(F.when(~inside, F.col("face")), 0.5).alias("around"))
    x = w.join(stats, "id", "left").join(runs, "id", "left")
    local = F.coalesce("around", "middle", F.lit(0.0))
    peak = F.coalesce("peak", F.lit(0.0))
    return x.select("id", peak.alias("peak"), F.coalesce("p99", F.lit(0.0)).alias("p99"), local.alias("local"), F.greatest(F.lit(0.0), peak - local).alias("delta"), F.coalesce("hot", F.lit(0)).alias("hot"), F.coalesce("run", F.lit(0)).alias("run"))


def voice_arousal(frames: DataFrame, keys: list[str], t: str, rms: str, pitch: str, crossings: str, variance: str, out: str) -> DataFrame:
    """Blend of energy .45, pitch rise .30 (between two voiced frames), rate .15 and burstiness .10, each as a robust level of its recording."""
    w = W.partitionBy(*keys).orderBy(t)
    before = F.lag(pitch).over(w)
    df = frames.withColumn("__rise", F.when((F.col(pitch) > 0) & (before > 0), F.greatest(F.lit(0.0), F.col(pitch) - before)).otherwise(0.0))
    weights = {rms: 0.45, "__rise": 0.30, crossings: 0.15, variance: 0.10}
    levels = {column: f"__level{i}" for i, column in enumerate(weights)}
    df = robust.with_saturations(df, keys, levels)
    total = F.lit(0.0)
    for column, weight in weights.items():
        total = total + weight * F.col(levels[column])
    return df.select(*frames.columns, clip(total, 0.0, 1.0).alias(out))


def loud_onsets(frames: DataFrame, keys: list[str], t: str, rms: str, out: str, rows: int = 8, low_db: float = 6.0, full_db: float = 18.0, floor: float = 0.003) -> DataFrame:
    """Rise in dB over the median of the rows before, 0 at low_db and 1 at full_db; 0 for the first row and below the floor."""
    base = F.percentile(rms, 0.5).over(W.partitionBy(*keys).orderBy(t).rowsBetween(-rows, -1))
    rise = 20 * F.log10(F.greatest(F.col(rms), F.lit(1e-8)) / F.greatest(base, F.lit(1e-8)))
    return frames.withColumn(out, F.when(base.isNull() | (F.col(rms) < floor), 0.0).otherwise(clip((rise - low_db) / (full_db - low_db), 0.0, 1.0)))


def event_evidence(frames: DataFrame, hits: DataFrame, keys: list[str], reach: float = 2.0, span: float = 15.0, boost: float = 0.40) -> DataFrame:
    """id, evidence, label and density of frames: hits spread over reach as triangles of their tier's weight, the greatest counts (the first of
    equals); dense action within span around a frame lifts it. frames: keys, id, t; hits: keys, h, at and tier."""
    weight = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    near = points_in(frames.select(*keys, "id", "t"), hits.withColumns({"lo": F.col("at") - reach, "hi": F.col("at") + reach}), keys, "t", ("lo", "hi"), 0.0, 2 * reach)
    value = F.coalesce(weight[F.col("tier")], F.lit(0.2)) * (1 - F.abs(F.col("t") - F.col("at")) / reach)
    best = near.select("id", value.alias("v"), "at", "h", "tier").where("v > 0").groupBy("id").agg(F.max("v").alias("v"), F.min_by("tier", F.struct((-F.col("v")).alias("v"), "at", "h")).alias("label"))
    acts = hits.where(F.col("tier").isin(DENSE)).withColumns({"lo": F.col("at") - span / 2, "hi": F.col("at") + span / 2})
    n = points_in(frames.select(*keys, "id", "t"), acts, keys, "t", ("lo", "hi"), 0.0, span).groupBy("id").agg(F.count("*").alias("n"))
    x = frames.select("id").join(best, "id", "left").join(n, "id", "left")
    dense = 1 + boost * F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - 1)
    return x.select("id", F.coalesce(F.least(F.lit(1.0), F.col("v") * dense), F.lit(0.0)).alias("evidence"), "label", dense.alias("density"))


def hype_track(words: DataFrame, keys: list[str], lexicon: DataFrame, reach: float = 1.5, step: float = 1.0) -> DataFrame:
    """keys, t and hype: phrases of the lexicon (phrase, weight) among the words in order, spread as triangles over whole steps; the greatest counts.
    words: keys, i (order), word (lower case) and at. Phrases of every length meet the run of as many words by an equi-join; longer ones than MOST_WORDS are refused."""
    w = W.partitionBy(*keys).orderBy("i")
    lex = lexicon.select(F.lower("phrase").alias("phrase"), "weight", F.size(F.split("phrase", " ")).alias("n"))
    sizes = sorted(r[0] for r in lex.select("n").distinct().limit(MOST_WORDS + 1).collect())
    if sizes and sizes[-1] > MOST_WORDS:
        raise ValueError(f"a phrase has {sizes[-1]} words, more than {MOST_WORDS}")
    x = words
    for k in range(1, max(sizes, default=1)):
        x = x.withColumn(f"w{k}", F.lead("word", k).over(w))
    runs = F.array(*[F.struct(F.lit(n).alias("n"), (F.concat_ws(" ", "word", *[f"w{k}" for k in range(1, n)]) if n == 1 else F.when(F.col(f"w{n - 1}").isNotNull(), F.concat_ws(" ", "word", *[f"w{k}" for k in range(1, n)]))).alias("phrase")) for n in sizes])
    hits = x.select(*keys, "at", F.inline(runs)).join(lex, ["phrase", "n"])
    spread = hits.select(*keys, "at", "weight", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - reach) / step)).cast("long"), F.ceil((F.col("at") + reach) / step).cast("long"))).alias("t"))
    value = F.col("weight") * (1 - F.abs(F.col("t") * step - F.col("at")) / reach)
    return spread.withColumn("v", value).where("v > 0").groupBy(*keys, "t").agg(F.max("v").alias("hype"))


def chat_windows(messages: DataFrame, keys: list[str], width: float, phrases: int = 5, most: int = 160) -> DataFrame:
    """keys, start, messages, emotes, intents, repeated (phrases said twice or more, at most so many, with counts) and strength of chat windows that hold
    something; of each recording the strongest. messages: keys, t, emotes, intent, weight and phrase (null: not to be kept).

    Counts per phrase come before counts per window, so a window's messages never meet in one place; no message said once is kept. Strengths equal to six
    places are equal and the earlier window leads: what is left of a sum beyond them depends on the order in which tasks add.
    """
    m = messages.withColumn("bin", F.floor(F.col("t") / width))
    totals = m.groupBy(*keys, "bin").agg(F.count("*").alias("messages"), F.sum("emotes").alias("emotes"), F.count_if("intent").alias("intents"), F.sum("weight").alias("weight"))
    said = m.where("phrase IS NOT NULL").groupBy(*keys, "bin", "phrase").agg(F.count("*").alias("n")).where("n >= 2")
    said = said.withColumn("place", F.row_number().over(W.partitionBy(*keys, "bin").orderBy(F.desc("n"), "phrase"))).where(F.col("place") <= phrases)
    top = said.groupBy(*keys, "bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase", "n"))), lambda x: F.concat(x["phrase"], F.lit(":"), x["n"].cast("string"))).alias("repeated"), F.sum("n").alias("votes"))
    x = totals.join(top, [*keys, "bin"], "left").where("repeated IS NOT NULL OR intents > 0 OR messages >= 8 OR emotes >= 6")
    x = x.withColumn("strength", F.col("weight") + 1.5 * F.coalesce("votes", F.lit(0)) + 3.0 * F.col("intents")).withColumn("start", F.col("bin") * width)
    return x.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("strength", 6)), "start"))).where(F.col("r") <= most).select(*keys, "start", "messages", "emotes", "intents", F.coalesce("repeated", F.array().cast("array<string>")).alias("repeated"), "strength")


def action_onsets(anchors: DataFrame, frames: DataFrame, keys: list[str], reach: float = 40.0, gap: float = 12.0, factor: float = 1.8, pad: float = 2.0, bucket: float = 60.0) -> DataFrame:
    """id and onset: how far back from an anchor the run of loud frames goes (loud: factor times the median of the stretch), with pauses up to gap. No row without such a
    run. anchors: keys, id, anchor; frames: keys, t, rms."""
    a = anchors.withColumn("lo", F.col("anchor") - reach)
    j = points_in(frames, a, keys, "t", ("lo", "anchor"), 0.0, bucket)
    j = j.withColumn("median", F.percentile("rms", 0.5).over(W.partitionBy("id")))
    back = W.partitionBy("id").orderBy(F.desc("t"))
    loud = j.where((F.col("median") > 0) & (F.col("rms") >= F.col("median") * factor))
    pause = F.coalesce(F.lag("t").over(back), F.col("anchor")) - F.col("t")
    kept = loud.withColumn("pause", pause).withColumn("worst", F.max("pause").over(back)).where(F.col("worst") <= gap)
    return kept.groupBy("id").agg((F.min("t") - pad).alias("onset"))


def settle_ends(anchors: DataFrame, frames: DataFrame, keys: list[str], least: float = 2.0, most: float = 5.0, quiet: float = 0.15, pad: float = 2.0, bucket: float = 60.0) -> DataFrame:
    """id and settle: pad after the second of two neighbouring quiet frames between least and most after the anchor. frames: keys, t, voice."""
    a = anchors.select(*keys, "id", "anchor", (F.col("anchor") + least).alias("lo"), (F.col("anchor") + most).alias("hi"))
    j = points_in(frames, a, keys, "t", ("lo", "hi"), 0.0, bucket)
    w = W.partitionBy("id").orderBy("t")
    j = j.withColumn("two", (F.col("voice") < quiet) & (F.lag("voice").over(w) < quiet))
    return j.where("two").groupBy("id").agg((F.min("t") + pad).alias("settle"))


def quiet_points(targets: DataFrame, frames: DataFrame, keys: list[str], reach: float = 2.0, bucket: float = 60.0) -> DataFrame:
    """targets with snapped: the quietest frame (the first of equals) within reach of the target, else the target itself. targets: keys, id, target."""
    x = targets.withColumns({"lo": F.col("target") - reach, "hi": F.col("target") + reach})
    best = points_in(frames.select(*keys, "t", "rms"), x, keys, "t", ("lo", "hi"), 0.0, bucket).groupBy("id").agg(F.min_by("t", F.struct("rms", "t")).alias("at"))
    return targets.join(best, "id", "left").select(*targets.columns, F.coalesce("at", "target").alias("snapped"))


def trim_dead_air(windows: DataFrame, frames: DataFrame, keys: list[str], run: float = 3.0, factor: float = 1.3, voice: float = 0.22, before: float = 1.0, after: float = 1.2, lead: float = 4.5, tail: float = 2.0, shortest: float = 8.0, bucket: float = 60.0) -> DataFrame:
    """id, start and end without a silent head or tail of run seconds or more. A frame is hot when louder than factor times the window's quietest, or voiced; the peak keeps its
    lead and tail, and a window that would fall below the shortest stays. windows: keys, id, start, end, peak; frames: keys, t, rms, voice."""
    j = points_in(frames, windows, keys, "t", ("start", "end"), 0.0, bucket).withColumn("floor", F.min("rms").over(W.partitionBy("id")) * factor + 1e-9)
    hot = (F.col("rms") > F.col("floor")) | (F.col("voice") >= voice)
    s = j.groupBy("id").agg(F.count("*").alias("n"), F.min(F.when(hot, F.col("t"))).alias("first"), F.max(F.when(hot, F.col("t"))).alias("last"))
    x = windows.join(s, "id", "left")
    a = F.when(F.col("first") - before - F.col("start") >= run, F.col("first") - before).otherwise(F.col("start"))
    b = F.when(F.col("end") - F.col("last") - after >= run, F.col("last") + after).otherwise(F.col("end"))
    x = x.withColumns({"a": F.greatest(F.lit(0.0), F.least(F.coalesce(a, "start"), F.col("peak") - lead)), "b": F.greatest(F.coalesce(b, "end"), F.col("peak") + tail)})
    fine = (F.coalesce("n", F.lit(0)) >= 3) & (F.col("b") - F.col("a") >= shortest)
    return x.select("id", F.when(fine, F.col("a")).otherwise(F.col("start")).alias("start"), F.when(fine, F.col("b")).otherwise(F.col("end")).alias("end"))


def sentences(words: DataFrame, keys: list[str], pause: float = 0.8) -> DataFrame:
    """keys, start and end of sentences: a word ends one when it ends in . ! or ? (closing marks aside), when a pause follows, or when it is the last. words: keys, start, end, word."""
    w = W.partitionBy(*keys).orderBy("start")
    stop = F.regexp_replace("word", "[\"'”’)\\]]+$", "").rlike("[.!?…]$") | (F.lead("start").over(w) - F.col("end") > pause)
    x = words.where("trim(word) <> ''").withColumn("__stop", F.coalesce(stop, F.lit(False)))
    x = islands(x, keys, ["start"], lambda o: F.lag("__stop").over(o))
    return x.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end")).drop("island")


def refine_to_sentences(windows: DataFrame, spoken: DataFrame, keys: list[str], reach: float = 3.5, forward: float = 7.0, preroll: float = 0.25, postpad: float = 0.35, lead: float = 4.5, tail: float = 2.0, shortest: float = 8.0, longest: float = 90.0, bucket: float = 60.0) -> DataFrame:
    """id, start and end moved to sentences: the start to the nearest beginning within reach, else the next one ahead of the peak's lead; the end to the
    nearest end ahead, also from a little earlier. What breaks the peak's margins or the limits of length keeps its window. windows: keys, id, start, end, peak."""

    def nearest(at: Column, column: str, lo: Column, hi: Column, name: str) -> DataFrame:
        x = windows.select(*keys, "id", at.alias("at"), lo.alias("lo"), hi.alias("hi"))
        return points_in(spoken.select(*keys, F.col(column).alias("t")), x, keys, "t", ("lo", "hi"), 0.0, bucket).groupBy("id").agg(F.min_by("t", F.struct(F.abs(F.col("t") - F.col("at")), "t")).alias(name))

    s0, e0, e1 = F.col("start") + preroll, F.col("end") - postpad, F.col("end") - 1.5
    x = windows.join(nearest(s0, "start", s0 - reach, s0 + reach, "s"), "id", "left").join(nearest(F.col("start"), "start", F.col("start"), F.least(F.col("start") + forward, F.col("peak") - lead), "f"), "id", "left")
    x = x.join(nearest(e0, "end", e0, e0 + reach, "e"), "id", "left").join(nearest(e1, "end", e1, e1 + reach, "g"), "id", "left")
    a = F.greatest(F.lit(0.0), F.least(F.coalesce(F.coalesce("s", "f") - preroll, "start"), F.col("peak") - lead))
    b = F.greatest(F.coalesce(F.coalesce("e", "g") + postpad, "end"), F.col("peak") + tail)
    fine = (b - a).between(shortest, longest)
    return x.select("id", F.when(fine, a).otherwise(F.col("start")).alias("start"), F.when(fine, b).otherwise(F.col("end")).alias("end"))


def credited(requests: DataFrame, frames: DataFrame, windows: DataFrame, keys: list[str], back: float = 35.0, delay: float = 2.0, onset: float = 0.0, bucket: float = 60.0) -> DataFrame:
    """request, peak, covering (windows that hold it), and start and end of what stands above the onset around the peak. The peak is the frame of
    highest score (the first of equals) between back and delay before the request. requests: keys, request, at; frames: keys, t, score; windows: keys, id, start, end."""
    r = requests.withColumns({"lo": F.col("at") - back, "hi": F.col("at") - delay})
    peak = points_in(frames, r, keys, "t", ("lo", "hi"), 0.0, bucket).groupBy(*keys, "request").agg(F.min_by("t", F.struct((-F.col("score")).alias("s"), "t")).alias("peak"))
    n = points_in(peak.withColumnRenamed("peak", "t"), windows, keys, "t", ("start", "end"), 0.0, bucket).groupBy("request").agg(F.count("*").alias("covering"))
    w = W.partitionBy(*keys).orderBy("t")
    runs = frames.withColumn("__run", F.sum((F.col("score") <= onset).cast("int")).over(w)).withColumn("__hot", F.col("score") > onset)
    spans = runs.where("__hot").groupBy(*keys, "__run").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    hit = points_in(peak.withColumnRenamed("peak", "t"), spans, keys, "t", ("start", "end"), 0.0, bucket).select("request", "start", "end")
    x = peak.join(n, "request", "left").join(hit, "request", "left")
    return x.select("request", "peak", F.coalesce("covering", F.lit(0)).alias("covering"), F.coalesce("start", "peak").alias("start"), F.coalesce("end", "peak").alias("end"))


def label_anchors(frames: DataFrame, windows: DataFrame, keys: list[str], label: str, gap: float, bucket: float = 60.0) -> DataFrame:
    """keys, start, end and anchor of runs of frames with a label (at most gap apart) whose anchor, the frame of most evidence (the first of equals), no window holds. frames: keys, t, label, evidence."""
    runs = islands(frames.where(F.col("label") == label), keys, ["t"], lambda w: F.col("t") - F.lag("t").over(w) > gap)
    runs = runs.groupBy(*keys, "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.min_by("t", F.struct((-F.col("evidence")).alias("e"), "t")).alias("t"))
    held = points_in(runs, windows.select(*keys, "start", "end"), keys, "t", ("start", "end"), 0.0, bucket, how="left_semi")
    return runs.join(held.select(*keys, "island"), [*keys, "island"], "left_anti").select(*keys, F.col("first").alias("start"), F.col("last").alias("end"), F.col("t").alias("anchor"))


def encounters(frames: DataFrame, keys: list[str], level: float = 0.10, gap: float = 4.0, least: float = 12.0, most: int = 6, order: tuple[str, ...] = ("t", "motion")) -> DataFrame:
    """keys, start, end and top of the strongest sustained encounters: runs of game audio above half its near-maximum with pauses up to gap, long enough and with at
    least the recording's median motion over all their frames, added in the given order. frames: keys, t, game_audio, motion and what order names."""
    bar = frames.groupBy(*keys).agg(F.greatest(F.lit(level), 0.5 * F.percentile("game_audio", 0.995)).alias("bar"), F.percentile("motion", 0.5).alias("usual"))
    x = frames.join(bar, keys).withColumn("hot", F.col("game_audio") >= F.col("bar"))
    runs = islands(x.where("hot"), keys, ["t"], lambda w: F.col("t") - F.lag("t").over(w) > gap).groupBy(*keys, "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max("game_audio").alias("top")).where(F.col("end") - F.col("start") >= least)
    moving = points_in(x.select(*keys, *dict.fromkeys(["t", "motion", *order]), "usual"), runs, keys, "t", ("start", "end"), 0.0, max(least, gap))
    moving = robust.ordered_means(moving, [*keys, "island", "usual"], list(order), ["motion"]).where("motion >= usual")
    kept = runs.join(moving, [*keys, "island"], "left_semi").withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("top"), "start")))
    return kept.where(F.col("r") <= most).select(*keys, "start", "end", "top")


