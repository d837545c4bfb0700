"""Evidence packs, montages, pools and policies over candidates, clips and moments of a recording."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions.intervals import overlap, overlap_of_shorter
from streamlens.functions.structures import labels
from streamlens.operators.intervals import islands, merge_spans, points_in, range_join
from streamlens.operators.robust import ordered_means


def matching_candidate(entries: DataFrame, candidates: DataFrame, keys: list[str], reach: float = 4.0, bucket: float = 60.0) -> DataFrame:
    """entry and the candidate that matches it best: one that overlaps it or peaks within reach of its middle, by 4 * share of the entry + 1 / (1 + distance); the first of
    equals. entries: keys, entry, a, b; candidates: keys, candidate, c, d and peak."""
    e = entries.withColumn("mid", (F.col("a") + F.col("b")) / 2)
    x = candidates.withColumns({"lo": F.least("c", F.col("peak") - reach), "hi": F.greatest("d", F.col("peak") + reach)})
    j = range_join(e, x, keys, ("a", "b"), ("lo", "hi"), 0.0, bucket)
    shared, far = overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")), F.abs(F.col("peak") - F.col("mid"))
    score = shared / F.greatest(F.lit(1.0), F.col("b") - F.col("a")) * 4 + 1 / (1 + far)
    hit = j.where((shared > 0) | (far <= reach))
    return hit.groupBy("entry").agg(F.min_by("candidate", F.struct((-F.round(score, 12)).alias("s"), "candidate")).alias("candidate"), F.max(score).alias("score"))


def signal_packs(targets: DataFrame, signals: DataFrame, keys: list[str], pad: float = 3.0, phrases: int = 6, bucket: float = 60.0) -> DataFrame:
    """target, samples, spikes, top_spike, mean_motion, top_motion and ocr (the best phrases in order) of the signals in each padded target. targets: keys, target, start, end;
    signals: keys, t, spike (score, null without one), motion, phrase, confidence and event (whether the phrase names one).

    Phrases are counted per target before they are ranked; a phrase's score is its best confidence, 1.5 for an event, its length up to .45, its nearness, less .35 when it is
    on the screen most of the time and names no event.
    """
    j = points_in(signals, targets, keys, "t", ("start", "end"), pad, bucket)
    s = j.groupBy("target").agg(F.count("*").alias("samples"), F.count("spike").alias("spikes"), F.coalesce(F.max("spike"), F.lit(0.0)).alias("top_spike"), F.avg("motion").alias("mean_motion"), F.max("motion").alias("top_motion"))
    far = F.abs(F.col("t") - (F.col("start") + F.col("end")) / 2)
    said = j.where("phrase IS NOT NULL").groupBy("target", F.lower("phrase").alias("key")).agg(F.min("phrase").alias("phrase"), F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min(far).alias("far"), F.max("event").alias("event")).join(s.select("target", "samples"), "target")
    score = F.col("confidence") + F.when(F.col("event"), 1.5).otherwise(0.0) + F.least(F.lit(0.45), F.length("phrase") / 100) + 0.25 / (1 + F.col("far")) - F.when((F.col("n") / F.col("samples") > 0.6) & ~F.col("event"), 0.35).otherwise(0.0)
    place = F.row_number().over(W.partitionBy("target").orderBy(F.desc(F.round(score, 9)), "far", "key"))
    best = said.withColumn("place", place).where(F.col("place") <= phrases).groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase"))), lambda x: x["phrase"]).alias("ocr"))
    return targets.select("target").join(s, "target", "left").join(best, "target", "left").fillna(0).withColumn("ocr", F.coalesce("ocr", F.array().cast("array<string>")))


def chat_packs(targets: DataFrame, windows: DataFrame, keys: list[str], pad: float = 3.0, bucket: float = 60.0) -> DataFrame:
    """target and sums of messages, emotes and intents of the chat windows that overlap each padded target, with the reactions they stand for. windows: keys, ws, we, messages, emotes, intents."""
    j = range_join(targets, windows, keys, ("start", "end"), ("ws", "we"), pad, bucket, strict=True)
    s = j.groupBy("target").agg(*[F.sum(c).alias(c) for c in ("messages", "emotes", "intents")])
    said = labels((F.col("messages") > 0, "chat burst"), ((F.col("messages") > 0) & (F.col("emotes") >= 6), "chat emote burst"), ((F.col("messages") > 0) & (F.col("intents") > 0), "viewer clip request"))
    return s.withColumn("reactions", said)


def unmatched(extra: DataFrame, taken: DataFrame, keys: list[str], limit: int, share: float = 0.5, bucket: float = 60.0) -> DataFrame:
    """Of each key's extra anchors (keys, id, a, b, strength) the strongest, limit of them, that no taken window (keys, c, d) covers for share or more."""
    j = range_join(extra, taken, keys, ("a", "b"), ("c", "d"), 0.0, bucket).where(overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")) >= share * (F.col("b") - F.col("a")))
    free = extra.join(j.select("id").distinct(), "id", "left_anti")
    return free.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("strength"), "a", "id"))).where(F.col("r") <= limit).drop("r")


def claimed_clips(moments: DataFrame, clips: DataFrame, keys: list[str], share: float = 0.5, bucket: float = 60.0) -> DataFrame:
    """moment, clip (null when none covers share of it) and strength (a kept clip adds 1, a passed one takes .5), each clip claimed once by its strongest moment. moments: keys, moment, a, b,
    strength; clips: keys, clip, c, d, kept, passed."""
    j = range_join(moments, clips, keys, ("a", "b"), ("c", "d"), 0.0, bucket)
    part = overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")) / F.greatest(F.lit(0.1), F.col("b") - F.col("a"))
    best = j.withColumn("part", part).where(F.col("part") >= share).groupBy("moment").agg(F.min_by(F.struct("clip", "kept", "passed"), F.struct((-F.round("part", 9)).alias("p"), "c", "clip")).alias("x"))
    m = moments.join(best, "moment", "left").select(*keys, "moment", "a", "b", F.col("x.clip").alias("clip"), (F.col("strength") + F.when(F.col("x.kept"), 1.0).when(F.col("x.passed"), -0.5).otherwise(0.0)).alias("strength"))
    first = F.row_number().over(W.partitionBy(*keys, "clip").orderBy(F.desc("strength"), "a", "moment"))
    return m.withColumn("first", F.when(F.col("clip").isNull(), 1).otherwise(first)).where("first = 1").drop("first")


def montage(moments: DataFrame, keys: list[str], seconds: float, budget: float, most: int) -> DataFrame:
    """keys, moment, position and start of a montage: in order of strength cuts of so many seconds around each moment, while they fit the budget and do not overlap; the
    strongest opens, the others follow in time. moments: keys, moment, at, strength.

    Moments without a neighbour within seconds never clash, so each run of neighbours is walked by itself, in order of strength; the budget then takes the strongest of what is left.
    """
    room = max(1, min(most, int(budget // seconds)))
    runs = islands(moments, keys, ["at", "moment"], lambda w: F.col("at") - F.lag("at").over(w) >= seconds)
    rows = runs.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), "at", "moment"))).alias("x"))

    def step(acc: Column, m: Column) -> Column:
        return F.when(F.exists(acc, lambda k: F.abs(k["at"] - m["at"]) < seconds), acc).otherwise(F.array_append(acc, m))

    kept = rows.select(*keys, F.explode(F.aggregate("x", F.array().cast(rows.schema["x"].dataType), step)).alias("m")).select(*keys, "m.moment", "m.at", "m.s")
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("s", "at", "moment"))).where(F.col("rank") <= room)
    order = F.row_number().over(W.partitionBy(*keys).orderBy((F.col("rank") != 1).cast("int"), "at", "moment"))
    return kept.select(*keys, "moment", (order - 1).alias("position"), F.greatest(F.lit(0.0), F.col("at") - seconds / 2).alias("start"))


def credit_regions(hits: DataFrame, keys: list[str], gap: float = 60.0, evidence: int = 6, before: float = 6.0, after: float = 18.0, join: float = 5.0) -> DataFrame:
    """keys, start, end, kinds and n of regions without content: hits (keys, t, score, kind) at most gap apart, with evidence enough or two hits, padded, and merged when at most join apart."""
    runs = islands(hits, [*keys, "kind"], ["t"], lambda w: F.col("t") - F.lag("t").over(w) > gap)
    runs = runs.groupBy(*keys, "kind", "island").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.sum("score").alias("score"), F.count("*").alias("n")).where((F.col("score") >= evidence) | (F.col("n") >= 2))
    spans = runs.select(*keys, F.greatest(F.lit(0.0), F.col("a") - before).alias("start"), (F.col("b") + after).alias("end"), "kind", "n")
    return merge_spans(spans, keys, "start", "end", join, F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"), F.sum("n").alias("n"))


def region_of(candidates: DataFrame, regions: DataFrame, keys: list[str], share: float = 0.5, bucket: float = 60.0) -> DataFrame:
    """id and region of candidates mostly inside one: the greatest share, then the most evidence, then the first. candidates: keys, id, a, b; regions: keys, region, c, d, n."""
    j = range_join(candidates, regions, keys, ("a", "b"), ("c", "d"), 0.0, bucket)
    part = F.when(F.col("b") > F.col("a"), overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")) / (F.col("b") - F.col("a"))).otherwise(0.0)
    return j.withColumn("part", part).where(F.col("part") >= share).groupBy("id").agg(F.min_by("region", F.struct((-F.round("part", 9)).alias("p"), (-F.col("n")).alias("n"), "region")).alias("region"))


def best_window(windows: DataFrame, candidates: DataFrame, keys: list[str], cover: float = 0.5, bucket: float = 60.0) -> DataFrame:
    """window, candidate and cover of the candidate that covers most of the shorter of both, then has the greater intersection over union. windows: keys, window, a, b; candidates: keys, candidate, c, d."""
    j = range_join(windows, candidates, keys, ("a", "b"), ("c", "d"), 0.0, bucket)
    span = [F.col(c) for c in "abcd"]
    both = overlap(*span)
    x = j.withColumns({"cover": overlap_of_shorter(*span), "iou": both / ((F.col("b") - F.col("a")) + (F.col("d") - F.col("c")) - both)}).where(F.col("cover") >= cover)
    return x.groupBy("window").agg(F.min_by("candidate", F.struct((-F.round("cover", 9)).alias("c"), (-F.round("iou", 9)).alias("i"), "candidate")).alias("candidate"), F.max("cover").alias("cover"))


def priority_regions(first: DataFrame, others: DataFrame, keys: list[str], budget: float, gap: float = 12.0, longest: float = 180.0) -> DataFrame:
    """keys, start and end: the first regions, merged under a gap and a bound, and of the others, in order of start, each that keeps the seconds of the union
    within the budget (at least the first ones' own); one that does not fit is left out and the next is tried. A recording without first regions keeps its others as they are.

    Rows stream by recording; a task holds the regions chosen so far of one recording, whose seconds the budget bounds.
    """
    spans = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), F.greatest(F.lit(0.0), F.col("start").cast("double")).alias("start"), F.col("end").cast("double").alias("end")).where("end > start")
    kinds = {f.name: f.dataType.simpleString() for f in first.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "start double", "end double"])

    def union(regions: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for a, b in sorted(regions):
            b = min(b, a + longest)
            if out and a <= out[-1][1] + gap and max(b, out[-1][1]) - out[-1][0] <= longest:
                a, b = out[-1][0], max(b, out.pop()[1])
            out.append((a, b))
        return out

    def finished(own: tuple | None, chosen: list[tuple[float, float]], room: float | None) -> list[tuple]:
        return [(*own, *x) for x in (union(chosen) if room is None else chosen)] if own is not None else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chosen, room = None, [], None
        for pdf in batches:
            done = []
            for row in pdf[[*keys, "kind", "start", "end"]].itertuples(index=False, name=None):
                own, (kind, a, b) = row[:-3], row[-3:]
                if own != now:
                    done += finished(now, chosen, room)
                    now, chosen, room = own, [], None
                if kind == 0:
                    chosen.append((a, b))
                elif not chosen:
                    done.append((*own, a, b))
                else:
                    if room is None:
                        chosen = union(chosen)
                        room = max(budget, sum(d - c for c, d in chosen))
                    tried = union([*chosen, (a, b)])
                    chosen = tried if sum(d - c for c, d in tried) <= room + 1e-6 else chosen
            yield pd.DataFrame(done, columns=[*keys, "start", "end"])
        yield pd.DataFrame(finished(now, chosen, room), columns=[*keys, "start", "end"])

    rows = spans(first, 0).unionByName(spans(others, 1))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "start", "end").mapInPandas(run, schema)


def content_shape(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shape, confidence and evidence of a recording, from rates over its candidates (rows of editorial.with_evidence with an id, in whose order means are added)."""
    seen = F.coalesce("verdict", F.lit("")) != ""
    rate = lambda c: F.coalesce(F.avg(F.when(seen, c.cast("double"))), F.lit(0.0))
    s = ordered_means(
        candidates, keys, ["id"], ["peak_value", "face_max", "voice"], F.avg((F.col("startle") >= 0.45).cast("double")).alias("startled"), F.avg(F.col("is_event").cast("double")).alias("events"),
        rate(F.col("moment_type") == "story").alias("story"), rate(F.col("moment_type").isin("funny", "fail", "rage")).alias("comic"), rate(F.col("verbal_payoff") & F.col("context_complete") & ~F.col("routine_only")).alias("verbal"),
    ).withColumnsRenamed({"peak_value": "peak", "face_max": "face"})
    # What speaks for which shape, and how much.
    rules = [
        ("narrative", 1.0, "low_mean_peak", F.col("peak") < 1.35), ("narrative", 2.0, "story_moment_density", F.col("story") >= 0.20), ("narrative", 1.5, "verbal_complete_density", F.col("verbal") >= 0.15), ("narrative", 0.75, "sparse_ocr_events", (F.col("events") < 0.08) & (F.col("peak") < 1.6)),
        ("chaos_comedy", 1.5, "face_or_startle_density", (F.col("face") >= 0.12) | (F.col("startled") >= 0.05)), ("chaos_comedy", 1.25, "high_mean_peak", F.col("peak") >= 1.8), ("chaos_comedy", 2.0, "funny_fail_density", F.col("comic") >= 0.20), ("chaos_comedy", 0.75, "voice_face_reaction", (F.col("voice") >= 0.25) & (F.col("face") >= 0.08)),
        ("competitive_mixed", 2.0, "ocr_event_density", F.col("events") >= 0.10), ("competitive_mixed", 0.75, "mid_arousal_band", F.col("peak").between(1.0, 2.2) & (F.col("comic") < 0.25)),
    ]
    shapes = ["narrative", "chaos_comedy", "competitive_mixed"]
    score = {n: sum((F.when(c, w).otherwise(0.0) for k, w, _, c in rules if k == n), F.lit(0.0)) for n in shapes}
    ranked = F.array_sort(F.array(*[F.struct((-score[n]).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(shapes)]))
    top, second = -ranked[0]["s"], -ranked[1]["s"]
    none = top < 0.75
    return s.select(*keys, F.when(none, "competitive_mixed").otherwise(ranked[0]["n"]).alias("shape"), F.when(none, 0.25).otherwise(F.least(F.lit(1.0), 0.35 + (top - second) * 0.25 + top * 0.15)).alias("confidence"), labels(*[(c, e) for _, _, e, c in rules], (none, "default_low_evidence")).alias("evidence"))


def second_look(trace: DataFrame, keys: list[str], limit: int, cover: float = 0.6, bucket: float = 60.0) -> DataFrame:
    """keys, id and place of the cards for a second look: rows under the ceiling, then overflow rows that both judges agree on, by the ranker's score where there is one, else by
    rank; the first limit of them, without groups or seconds already in the deck, one of each group. trace: keys, id, start, end, disposition, group, ranker (may be null), rank, consensus."""
    scored = F.col("ranker").isNotNull()
    order = [F.col("tier"), (~scored).cast("int"), F.when(scored, -F.col("ranker")).otherwise(F.col("rank").cast("double")), F.col("rank"), F.col("start"), F.col("id")]
    pool = trace.withColumn("tier", F.when(F.col("disposition") == "clip_ceiling", 0).when((F.col("disposition") == "editorial_overflow_cutoff") & F.col("consensus"), 1)).where("tier IS NOT NULL AND end > start")
    top = pool.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= limit)
    deck = trace.where("disposition LIKE 'selected%' AND end > start")
    left = top.join(deck.select(*keys, "group").where("group IS NOT NULL").distinct(), [*keys, "group"], "left_anti")
    j = range_join(left.select(*keys, "id", F.col("start").alias("a"), F.col("end").alias("b")), deck.select(*keys, F.col("start").alias("c"), F.col("end").alias("d")), keys, ("a", "b"), ("c", "d"), 0.0, bucket)
    held = j.where(overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")) >= cover * (F.col("b") - F.col("a"))).select("id").distinct()
    free = left.join(held, "id", "left_anti").withColumn("first", F.row_number().over(W.partitionBy(*keys, F.coalesce("group", F.col("id").cast("string"))).orderBy("n"))).where("first = 1")
    return free.select(*keys, "id", F.row_number().over(W.partitionBy(*keys).orderBy("n")).alias("place"))


def budgeted_pool(pool: DataFrame, keys: list[str], budget: int, anchor: Column, signal: str, potential: str, middle: Column) -> DataFrame:
    """keys, id and reason of a judge's pool: anchors by potential, then the best by signal up to a third of the budget, by potential up to half, the best of each stretch of
    time for what is left, and the next best to fill it. pool: keys, id, end, signal and potential, without framing variants.

    Every stage is a rank over the rows that the stages before left, so a recording's rows are only ever ordered, not walked.
    """
    every = W.partitionBy(*keys)
    x = pool.withColumn("reason", F.when(anchor, F.lit("anchor")))
    x = x.withColumn("reason", F.when(F.col("reason").isNotNull() & (F.row_number().over(W.partitionBy(*keys, F.col("reason").isNull()).orderBy(F.desc(potential), "id")) <= budget), F.col("reason")))

    def fill(x: DataFrame, target: Column, column: str, name: str) -> DataFrame:
        x = x.withColumn("have", F.count("reason").over(every))
        place = F.row_number().over(W.partitionBy(*keys, F.col("reason").isNull()).orderBy(F.desc(column), "id"))
        return x.withColumn("reason", F.coalesce("reason", F.when(place <= target - F.col("have"), F.lit(name)))).drop("have")

    x = fill(x, F.lit(max(1, budget // 3)), signal, "signals_challenger")
    x = fill(x, F.lit(max(1, budget // 2)), potential, "raw_challenger")
    x = x.withColumn("slots", budget - F.count("reason").over(every)).withColumn("length", F.max("end").over(every))
    stretch = F.least(F.col("slots") - 1, F.greatest(F.lit(0), F.floor(middle / F.col("length") * F.col("slots"))))
    x = x.withColumn("bin", F.when((F.col("slots") > 0) & (F.col("length") > 0), stretch))
    place = F.row_number().over(W.partitionBy(*keys, F.col("reason").isNull(), "bin").orderBy(F.desc(potential), "id"))
    x = x.withColumn("reason", F.coalesce("reason", F.when(F.col("bin").isNotNull() & (place == 1), F.lit("temporal"))))
    x = fill(x, F.lit(budget), potential, "global_fill")
    return x.where("reason IS NOT NULL").select(*keys, "id", "reason")


def game_segments(hits: DataFrame, bounds: DataFrame, keys: list[str], width: float, hop: float, votes: int = 2, bridge: int = 1) -> DataFrame:
    """keys, start, end and game of a recording's segments. Every hop the game with most distinct phrases in the window wins, if it alone has the most, at least two, and .4 of
    all; a new game is taken up after so many wins in a row, short stretches without one are bridged, equal neighbours are joined. hits: keys, t, game, phrase; bounds: keys, length."""
    hops = bounds.select(*keys, "length", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("length") / hop) - 1).cast("int"))).alias("hop"))
    copies = max(1, -(-int(width) // int(hop)))
    near = hits.select(*keys, "game", "phrase", "t", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("back")).withColumn("hop", (F.floor(F.col("t") / hop) - F.col("back")).cast("int"))
    near = near.where((F.col("hop") >= 0) & (F.col("t") < F.col("hop") * hop + width))
    n = near.groupBy(*keys, "hop", "game").agg(F.count_distinct("phrase").alias("n"))
    w = W.partitionBy(*keys, "hop")
    n = n.withColumn("top", F.max("n").over(w)).withColumn("all", F.sum("n").over(w))
    won = n.groupBy(*keys, "hop").agg(F.count_if(F.col("n") == F.col("top")).alias("leaders"), F.max("top").alias("top"), F.max("all").alias("all"), F.max_by("game", "n").alias("game")).where("leaders = 1 AND top >= 2 AND top >= 0.4 * all")
    x = hops.join(won.select(*keys, "hop", "game"), [*keys, "hop"], "left").withColumn("game", F.coalesce("game", F.lit("generic")))
    # a game is taken up at the place in its run of wins that makes votes of them; until then the one before goes on
    won = islands(x, keys, ["hop"], lambda o: F.col("game") != F.lag("game").over(o), "__run")
    place, hop_ = F.row_number().over(W.partitionBy(*keys, "__run").orderBy("hop")), W.partitionBy(*keys).orderBy("hop")
    won = won.withColumn("__taken", F.when((place >= votes) | F.lag("hop").over(hop_).isNull(), F.col("game")))
    smooth = won.select(*keys, "length", "hop", F.last("__taken", ignorenulls=True).over(hop_.rowsBetween(W.unboundedPreceding, 0)).alias("game"))
    runs = islands(smooth, keys, ["hop"], lambda o: F.col("game") != F.lag("game").over(o)).groupBy(*keys, "island", "length").agg(F.first("game").alias("game"), F.min("hop").alias("a"), F.count("*").alias("n"))
    o = W.partitionBy(*keys).orderBy("a")
    dip = (F.col("game") == "generic") & (F.col("n") <= bridge) & (F.lag("game").over(o) != "generic") & (F.lag("game").over(o) == F.lead("game").over(o))
    runs = runs.withColumn("game", F.when(dip, F.lag("game").over(o)).otherwise(F.col("game")))
    joined = islands(runs.drop("island"), keys, ["a"], lambda q: F.col("game") != F.lag("game").over(q)).groupBy(*keys, "island", "length").agg(F.first("game").alias("game"), F.min("a").alias("a"))
    return joined.select(*keys, (F.col("a") * hop).alias("start"), F.coalesce(F.lead("a").over(W.partitionBy(*keys).orderBy("a")) * hop, F.col("length")).alias("end"), "game")
