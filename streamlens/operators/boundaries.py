"""From an arc of reaction to the window that is shown: quiet places and cuts, room around peak and anchor, length, whole sentences, and where the play before an event begins.

Every rule is a column over a window joined with the few frames or sentences near it; joins are bucketed by time, so no recording has to fit anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.operators.intervals import islands, points_in
from streamlens.operators.windows import action_onsets


@dataclass(frozen=True)
class Bounds:
    """Seconds around peaks and anchors, and lengths (fixed values)."""

    reach: float = 2.0
    near_quiet: float = 1.25
    lead_pad: float = 2.5
    tail_pad: float = 3.0
    lead: float = 4.5
    tail: float = 2.0
    event_lead: float = 7.5
    event_tail: float = 5.0
    event_longest: float = 42.0
    onset_longest: float = 58.0
    shortest: float = 8.0
    longest: float = 90.0
    preroll: float = 0.25
    postpad: float = 0.35
    context: float = 12.0
    bridge: float = 4.0
    next_bridge: float = 2.5
    win_lead: float = 14.0
    win_least: float = 10.0
    win_back: float = 24.0
    win_gap: float = 3.0


EVENTS = ["elimination", "knock"]


def quiet_or_cut(targets: DataFrame, frames: DataFrame, keys: list[str], b: Bounds = Bounds(), bucket: float = 60.0) -> DataFrame:
    """id, which and snapped: within reach of the target the quietest frame, or of those nearly as quiet the cut nearest to it; the target itself without frames.

    targets: keys, id, which, target; frames: keys, t, rms and, where known, cut (boolean).
    """
    f = frames.select(*keys, "t", "rms", (F.coalesce("cut", F.lit(False)) if "cut" in frames.columns else F.lit(False)).alias("cut"))
    x = targets.withColumns({"__lo": F.col("target") - b.reach, "__hi": F.col("target") + b.reach})
    own = W.partitionBy("id", "which")
    j = points_in(f, x, keys, "t", ("__lo", "__hi"), 0.0, bucket).withColumn("__floor", F.min("rms").over(own) * b.near_quiet + 1e-9)
    good = F.col("cut") & (F.col("rms") <= F.col("__floor"))
    best = j.groupBy("id", "which").agg(F.min_by("t", F.struct("rms", "t")).alias("__quiet"), F.min_by(F.when(good, F.col("t")), F.when(good, F.struct(F.abs(F.col("t") - F.col("target")).alias("d"), "t"))).alias("__cut"))
    return targets.join(best, ["id", "which"], "left").select("id", "which", F.coalesce("__cut", "__quiet", "target").alias("snapped"))


def _snapped(x: DataFrame, frames: DataFrame, keys: list[str], b: Bounds, bucket: float, **targets: Column) -> DataFrame:
    """x with a column for each target, at its quiet place (null where the target is)."""
    named = F.array(*[F.struct(F.lit(n).alias("which"), c.alias("target")) for n, c in targets.items()])
    t = x.select(*keys, "id", F.inline(named)).where("target IS NOT NULL")
    s = quiet_or_cut(t, frames, keys, b, bucket).groupBy("id").agg(*[F.max(F.when(F.col("which") == n, F.col("snapped"))).alias(n) for n in targets])
    return x.join(s, "id", "left")


def snapped_windows(arcs: DataFrame, frames: DataFrame, keys: list[str], b: Bounds = Bounds(), bucket: float = 60.0) -> DataFrame:
    """id, start, end and padded (whether the arc was too short by itself) of arcs with room around them, at quiet places.

    arcs: keys, id, start, end, peak, anchor, label and settle (where voices settle after an event; these three may be null). The peak and the anchor keep their lead and tail; an event's window is cut where
    voices have settled; one too short is opened backward, one too long loses its lead first.
    """
    event = F.coalesce(F.col("label").isin(EVENTS), F.lit(False)) & F.col("anchor").isNotNull()
    x = arcs.withColumn("__event", event).withColumn("settle", F.when(F.col("__event"), F.col("settle")))
    x = _snapped(x, frames, keys, b, bucket, __a=F.col("start") - b.lead_pad, __e=F.col("end") + b.tail_pad, __s=F.col("settle"))
    settled = F.col("settle").isNotNull()
    tail = F.when(settled, F.greatest(F.lit(b.tail), F.least(F.lit(b.event_tail), F.col("settle") - F.col("anchor")))).when(F.col("__event"), b.event_tail).otherwise(b.tail)
    x = x.withColumns({"__tail": tail, "__lead": F.when(F.col("__event"), b.event_lead).otherwise(b.lead), "__most": F.when(F.col("__event"), min(b.longest, b.event_longest)).otherwise(b.longest)})
    # least and greatest pass over a missing anchor
    x = x.withColumns({"__a": F.greatest(F.lit(0.0), F.least("__a", F.col("peak") - b.lead, F.col("anchor") - F.col("__lead"))), "__e": F.greatest("__e", F.col("peak") + b.tail, F.col("anchor") + F.col("__tail"))})
    late = settled & (F.col("__e") > F.col("settle"))
    x = x.withColumn("__e", F.when(late, F.greatest("__s", F.col("anchor") + b.tail, F.col("peak") + b.tail)).otherwise(F.col("__e")))
    x = x.withColumns({"__short": F.col("__e") - F.col("__a") < b.shortest, "__long": F.col("__e") - F.col("__a") > F.col("__most")})
    x = _snapped(x, frames, keys, b, bucket, __back=F.when(F.col("__short"), F.col("__a") - (b.shortest - (F.col("__e") - F.col("__a")))))
    opened = F.greatest(F.lit(0.0), F.least("__back", F.col("__e") - b.shortest + b.tail_pad))
    cut = F.greatest("__a", F.col("__e") - F.col("__most"))
    x = x.withColumns({"__o": opened, "__c": cut, "__early": cut > F.col("peak") - b.lead})
    x = x.withColumn("__c", F.when(F.col("__early"), F.greatest(F.lit(0.0), F.col("peak") - b.lead)).otherwise(F.col("__c")))
    x = x.withColumn("__ce", F.when(F.col("__early"), F.col("__c") + F.col("__most")).otherwise(F.col("__e")))
    x = x.withColumns({"__c": F.least("__c", F.when(F.col("anchor").isNotNull(), F.greatest(F.lit(0.0), F.col("anchor") - F.col("__lead")))), "__ce": F.greatest("__ce", F.col("anchor") + F.col("__tail"))})
    x = x.withColumn("__c", F.when(F.col("anchor").isNotNull() & (F.col("__ce") - F.col("__c") > F.col("__most")), F.greatest(F.lit(0.0), F.col("__ce") - F.col("__most"))).otherwise(F.col("__c")))
    start = F.when(F.col("__short"), F.col("__o")).when(F.col("__long"), F.col("__c")).otherwise(F.col("__a"))
    end = F.when(F.col("__short"), F.greatest("__e", F.col("__o") + b.shortest)).when(F.col("__long"), F.col("__ce")).otherwise(F.col("__e"))
    return x.select("id", F.round(F.greatest(F.lit(0.0), start), 3).alias("start"), F.round(end, 3).alias("end"), F.col("__short").alias("padded"))


def reopened(windows: DataFrame, frames: DataFrame, keys: list[str], b: Bounds = Bounds(), bucket: float = 60.0, **onset: float) -> DataFrame:
    """id and start: a window of an event opened where the fight before it begins, as far as its length allows; others keep their start. windows: keys, id, start, end, anchor, label."""
    events = windows.where(F.col("label").isin(EVENTS) & F.col("anchor").isNotNull())
    x = windows.join(action_onsets(events.select(*keys, "id", "anchor"), frames, keys, bucket=bucket, **onset), "id", "left")
    x = _snapped(x, frames, keys, b, bucket, __n=F.when(F.col("onset") < F.col("start"), F.col("onset")))
    most = min(b.longest, b.onset_longest)
    new = F.greatest(F.lit(0.0), F.col("__n"), F.col("end") - most)
    return x.select("id", F.when(F.col("__n").isNotNull() & (new < F.col("start")), F.round(new, 3)).otherwise(F.col("start")).alias("start"))


def with_context(windows: DataFrame, spoken: DataFrame, frames: DataFrame, keys: list[str], b: Bounds = Bounds(), bucket: float = 60.0) -> DataFrame:
    """id, start and end widened to neighbouring sentences: the one that the start cuts or that ends shortly before it, and up to three close ones behind the end. What is selected always stays.

    windows: keys, id, start, end, lead and tail (whether to widen there); spoken: keys, start, end of sentences; frames: keys, t, rms. Too long for both sides, the lead is preferred, then the tail.
    """
    o = W.partitionBy(*keys).orderBy("start")
    s = spoken.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), *[F.lead(c, k).over(o).alias(f"{c[0]}{k}") for k in (1, 2) for c in ("start", "end")])
    before = windows.where("lead").select(*keys, "id", (F.col("start") - b.context).alias("lo"), (F.col("start") - 0.05).alias("hi"))
    prior = points_in(s.select(*keys, F.col("s").alias("t"), "e"), before, keys, "t", ("lo", "hi"), 0.0, bucket, closed=False).groupBy("id").agg(F.max_by(F.struct("t", "e"), "t").alias("__p"))
    after = windows.where("tail").select(*keys, "id", F.col("end").alias("stop"), (F.col("end") + 0.05).alias("lo"), (F.col("end") + b.context).alias("hi"))
    follow = points_in(s.withColumn("t", F.col("e")), after, keys, "t", ("lo", "hi"), 0.0, bucket).where("t > lo").groupBy("id").agg(F.min_by(F.struct("s", "e", "s1", "e1", "s2", "e2", "stop"), "s").alias("__f"))
    x = windows.join(prior, "id", "left").join(follow, "id", "left")
    p, f = F.col("__p"), F.col("__f")
    joined = (p["e"] >= F.col("start") - 0.05) | (F.col("start") - p["e"]).between(0.0, b.bridge)
    near = lambda a, e: F.coalesce((a >= 0) & (a <= b.next_bridge) & (e - f["stop"] <= b.context), F.lit(False))
    one = near(f["s1"] - f["e"], f["e1"])
    two = one & near(f["s2"] - f["e1"], f["e2"])
    last = F.when((f["s"] - F.col("end")).between(0.0, b.bridge), F.when(two, f["e2"]).when(one, f["e1"]).otherwise(f["e"]))
    x = x.withColumns({"__a": F.when(joined, p["t"]), "__b": last})
    x = _snapped(x, frames, keys, b, bucket, __qa=F.col("__a") - 1.0, __qb=F.col("__b") + 1.0)
    length = frames.groupBy(*keys).agg(F.max("t").alias("__length"))
    x = x.join(length, keys, "left")
    a = F.when(F.col("__a").isNotNull(), F.greatest(F.lit(0.0), F.least(F.col("__a") - b.preroll, "__qa", "start"))).otherwise(F.col("start"))
    e = F.when(F.col("__b").isNotNull(), F.least(F.coalesce("__length", F.col("__b") + b.postpad), F.greatest(F.col("__b") + b.postpad, "__qb", "end"))).otherwise(F.col("end"))
    x = x.withColumns({"__a": a, "__e": e})
    over = F.col("__e") - F.col("__a") > b.longest
    lead_fits, tail_fits = F.col("end") - F.col("__a") <= b.longest, F.col("__e") - F.col("start") <= b.longest
    start = F.when(~over | lead_fits, F.col("__a")).otherwise(F.col("start"))
    end = F.when(~over | (~lead_fits & tail_fits), F.col("__e")).otherwise(F.col("end"))
    return x.select("id", F.round(start, 3).alias("start"), F.round(end, 3).alias("end"))


def win_leads(anchors: DataFrame, frames: DataFrame, keys: list[str], b: Bounds = Bounds(), bucket: float = 60.0) -> DataFrame:
    """id and start of a win's window: a little before the run of active frames nearest to the banner, at least win_least before it; without one, win_lead before it.

    Active: a score of the recording's median and .35 of its spread (.45 at least), or an event's label. anchors: keys, id, anchor; frames: keys, t, score, label.
    """
    middle = frames.groupBy(*keys).agg(F.percentile("score", 0.5).alias("__m"))
    spread = frames.join(middle, keys).groupBy(*keys).agg(F.first("__m").alias("__m"), (F.percentile(F.abs(F.col("score") - F.col("__m")), 0.5) * 1.4826).alias("__d"))
    room = b.longest - b.tail
    look = anchors.select(*keys, "id", "anchor", F.greatest(F.lit(0.0), F.col("anchor") - min(b.win_back, room)).alias("lo"), F.greatest(F.lit(0.0), F.col("anchor") - b.tail).alias("hi"))
    j = points_in(frames, look, keys, "t", ("lo", "hi"), 0.0, bucket).join(spread, keys)
    on = j.where((F.col("score") >= F.greatest(F.lit(0.45), F.col("__m") + 0.35 * F.col("__d"))) | F.coalesce(F.col("label").isin(EVENTS), F.lit(False)))
    runs = islands(on, ["id"], ["t"], lambda o: F.col("t") - F.lag("t").over(o) > b.win_gap).groupBy("id", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    last = runs.groupBy("id").agg(F.max_by("first", "last").alias("__first"))
    x = anchors.join(last, "id", "left")
    zero = lambda c: F.greatest(F.lit(0.0), c)
    found = F.least(zero(F.col("__first") - 3.0), zero(F.col("anchor") - b.win_least))
    return x.select("id", F.when(F.col("__first").isNotNull(), found).otherwise(zero(F.col("anchor") - min(b.win_lead, room))).alias("start"))


def marked(markers: DataFrame, frames: DataFrame, windows: DataFrame, keys: list[str], onset: float, bucket: float = 60.0) -> DataFrame:
    """marker, peak, id, start and end: the strongest reaction in a marker's region, the window it credits (of those that hold the peak the one with most reaction, the first of equals), and
    without one the stretch above the onset around the peak. Regions without frames have no row. markers: keys, marker, lo, hi; frames: keys, t, score; windows: keys, id, start, end, auc."""
    peak = points_in(frames, markers, keys, "t", ("lo", "hi"), 0.0, bucket).groupBy(*keys, "marker").agg(F.min_by("t", F.struct((-F.col("score")).alias("s"), "t")).alias("t"))
    held = points_in(peak, windows, keys, "t", ("start", "end"), 0.0, bucket).groupBy("marker").agg(F.max_by(F.struct("id", "start", "end"), F.struct(F.coalesce("auc", F.lit(0.0)).alias("a"), (-F.col("id")).alias("i"))).alias("__w"))
    w = W.partitionBy(*keys).orderBy("t")
    runs = frames.withColumns({"__run": F.sum((F.col("score") <= onset).cast("int")).over(w), "__hot": F.col("score") > onset})
    spans = runs.where("__hot").groupBy(*keys, "__run").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    free = points_in(peak, spans, keys, "t", ("start", "end"), 0.0, bucket).select("marker", F.struct("start", "end").alias("__s"))
    x = peak.join(held, "marker", "left").join(free, "marker", "left")
    return x.select("marker", F.col("t").alias("peak"), F.col("__w.id").alias("id"), F.coalesce("__w.start", "__s.start", "t").alias("start"), F.coalesce("__w.end", "__s.end", "t").alias("end"))
